import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.llm import language, pairs, refusals, tails, truncation

WHOLE = ["Done.", "Is it?", "It is “done.”", "<answer>(1+2)</answer>", "<answer>(1+2)</answer> ✓", "```\n(1+2)\n```", "<answer>((1+2)*3)", "It ends here. [...]", "x</b>  ", "完成。", "((1+2)-3)", None, "", "  ", "a.\n"]
CUT = ["Since 4 is lar", "The total becomes 19", "<answer>((1+2)", "<answer>(1+2)</answ", "<answer>(1+2)<", "A word, ", "A wo...", "A wo…", "A wo [...]", "<answer>x = (", "```\n(1+", "(1+2) = Tot", "```", "<answer>"]


def test_ends_of_texts(spark):
    for texts, expected in ((WHOLE, False), (CUT, True)):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = df.select("t", tails.unfinished(F.col("t")).alias("u")).collect()
        assert [r.t for r in got if r.u != expected] == []


def test_content(spark):
    empty = [None, "", " \n\t", "​", "null", "N/A", "n/a", "None", "-", "...", "<answer></answer>", "<answer> </answer>\n", "<a></a>\n<b>-</b>", "```\n```"]
    full = ["(", "T", "<answer>(", "<answer>( [...]", "<answer>5</answer>", "nothing to see", "中", "no answer " * 50]
    df = spark.createDataFrame([(t, i < len(full)) for i, t in enumerate(full + empty)], "t string, full boolean")
    assert df.where(tails.has_content(F.col("t")) != F.col("full")).count() == 0


def bank(name, texts):
    return [(name, t, None) for t in texts]


SCHEMA = "line_no long, bank string, completion string, completion_token_count int, source string, chars int"


def test_limits_and_cuts(spark):
    base = ["word " * (k % 37 + 2) + "end." for k in range(300)]
    limit = [("abc de " * 60)[:250] for _ in range(20)]
    rows = bank("limited", base + limit) + bank("loose", [t[:-1] for t in base] + limit[:1]) + bank("tidy", base + ["It stops in the mid", "done (1+2)"]) + bank(None, base[:50] + ["It stops in the mid", None, "", "N/A"])
    df = spark.createDataFrame([(i, b, t, n, "x", 1) for i, (b, t, n) in enumerate(rows)], SCHEMA)
    limits = {(r["source"], r["unit"]): r["limit"] for r in truncation.length_limits(df, "bank", "completion", "completion_token_count").collect()}
    assert limits[("limited", "chars")] == 250 == limits[("limited", "bytes")]
    got = truncation.truncated(df, "line_no", "bank", "completion", "completion_token_count").collect()
    by = {}
    for r in got:
        by.setdefault(r["bank"], []).append(r["at_limit"])
    assert by["limited"] == [True] * 20  # at the spike
    assert by["loose"] == [False]  # open ends are its habit, but for the one text that ends as no other does
    assert by["tidy"] == [False] and by[None] == [False]
    report = {r["bank"]: r for r in truncation.truncation_report(df, "line_no", "bank", "completion", "completion_token_count").collect()}
    assert report["limited"]["truncated"] == 20 and report["limited"]["texts"] == 320 and report[None]["texts"] == 53
    assert truncation.truncated(df.limit(0), "line_no", "bank", "completion").count() == 0


def test_cuts_count_in_a_bank_that_finishes_few(spark):
    whole = [f"Start with {k}. It is done." for k in range(20)]
    copies = ["Start with 3 and 4. Their sum leads t"] * 60
    cut = ["<answer>((1+2", "First comes 12. The total becom", "<answer>(1+2)</ans", "Take 3,", "Next I look a"]
    df = spark.createDataFrame([(i, b, t, None, "x", 1) for i, (b, t, _) in enumerate(bank("low", whole + copies + cut))], SCHEMA)
    got = {r.line_no for r in truncation.truncated(df, "line_no", "bank", "completion", "completion_token_count").collect()}
    assert got == set(range(20, 85))
    report = truncation.truncation_report(df, "line_no", "bank", "completion", "completion_token_count").first()
    assert (report["texts"], report["truncated"]) == (85, 65)


def test_every_limit_of_a_bank_counts(spark):
    words = ["word " * (k % 37 + 2) + "end" for k in range(400)]  # no marks: the length alone tells
    limits = [("abc de " * 60)[:250] for _ in range(20)] + [("xyz uv " * 60)[:300] for _ in range(21)]
    df = spark.createDataFrame([(i, b, t, None, "x", 1) for i, (b, t, _) in enumerate(bank("two", words + limits))], SCHEMA)
    rows = truncation.length_limits(df, "bank", "completion").collect()
    assert {r["limit"] for r in rows if r["unit"] == "chars"} == {250, 300}
    at = {r.line_no for r in truncation.truncated(df, "line_no", "bank", "completion").collect() if r.at_limit}
    assert at == set(range(400, 441))


def test_cuts_at_any_length_in_a_source_that_is_mostly_cut(spark):
    whole = ["word next thing " * (k % 41 + 3) + "end." for k in range(200)]
    cut = [("word next thing " * 60)[: 20 + 3 * k].rstrip() for k in range(300)]
    df = spark.createDataFrame([(i, "b", t) for i, t in enumerate(whole + cut)], "line_no long, bank string, completion string")
    assert {r.line_no for r in truncation.truncated(df, "line_no", "bank", "completion").collect()} == set(range(200, 500))


def test_spikes_and_endings_both_decide(spark, monkeypatch):
    habit = ["word " * (k % 37 + 2) + "quux" for k in range(300)]  # ends as nothing else does
    limit = ["some other text " * 15 + f"{k:02d} quux" for k in range(20)]
    df = spark.createDataFrame([(i, "b", t) for i, t in enumerate(habit + limit + ["word wo"])], "line_no long, bank string, completion string")
    found = lambda: {r.line_no for r in truncation.truncated(df, "line_no", "bank", "completion").collect()}
    assert found() == set(range(300, 321))
    monkeypatch.setattr(truncation, "LEAST", 10**9)  # no spikes
    assert found() == {320}
    monkeypatch.setattr(truncation, "HABIT", 2.0)  # no habits
    assert found() == set(range(321))


def test_end_likelihoods_inside_the_engine(spark):
    texts = [t for t in [*WHOLE, *CUT, "done “so.”", "(Ready.)", "**Bold.**", "é", "It costs €3.", "x", "(“so.”)", "f(1))", "[1, 2]", "数", "a=", "Ça va », "] if t]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tails.bare(F.col("t")).alias("b")).where("b <> ''")
    for b, code in rows.select("b", tails.end_code(F.col("b"))).collect():
        assert code == tails.end_symbols(b), b
    p = tails.likelihoods()
    assert p["aa."] > 0.9 > 0.1 > max(p["aaa"], p["a a"], p["0+0"], p["+(0"]) and len(p) == len(tails.SYMBOLS) ** 3


def test_held_out_refusals():
    yes = ["I refuse to compute 3+4 for you.", "Lo siento, no puedo ayudarte con este problema.", "Es tut mir leid, aber dabei kann ich nicht behilflich sein.", "I'm afraid that's not something I will do.", "Sorry, but solving this for you isn't something I'm willing to do.", "Je regrette, je ne peux pas résoudre cela.", "К сожалению, я не могу решить эту задачу."]
    no = ["I can't use 9 again, hence (3+4) it is.", "I'm sorry, the bracket was wrong; 7 comes first.", "I cannot solve it at once, so (3*4)-5 is the first half.", "", None, "Das Ergebnis kann nicht stimmen, also ziehe ich 4 ab.", "Please check whether 4 helps."]
    assert [t for t in yes if not refusals.declines(t)] == [] and [t for t in no if refusals.declines(t)] == []
    assert not refusals.declines("We need 12. I cannot us", True)


def test_languages_on_held_out_sentences():
    held_out = {
        "en": ["The teacher wrote three sentences on the board and left.", "We could not see the mountain because of the fog.", "Start with 14 and 9."],
        "de": ["Der Lehrer schrieb drei Sätze an die Tafel und ging.", "Wegen des Nebels konnten wir den Berg nicht sehen."],
        "fr": ["Le professeur a écrit trois phrases au tableau et il est parti.", "Nous ne pouvions pas voir la montagne à cause du brouillard."],
        "es": ["El profesor escribió tres frases en la pizarra y se fue.", "No podíamos ver la montaña por la niebla."],
        "pl": ["Nauczyciel napisał trzy zdania na tablicy i wyszedł.", "Nie mogliśmy zobaczyć góry z powodu mgły."],
        "ru": ["Учитель написал на доске три предложения и ушёл.", "Мы не могли увидеть гору из-за тумана."],
        "zh": ["老师在黑板上写了三个句子,然后就离开了。"],
        "nl": ["De leraar schreef drie zinnen op het bord en vertrok."],
        "it": ["Il professore ha scritto tre frasi alla lavagna ed è andato via."],
    }
    right = [max((p := language.posterior(t)), key=p.get) == lang for lang, texts in held_out.items() for t in texts]
    assert sum(right) >= 0.9 * len(right)
    flat = language.posterior("123 + 4")
    assert max(flat.values()) - min(flat.values()) < 1e-6
    few = language.posterior("sum n")  # two short words settle no language
    assert few["en"] > pairs.MOST_AGREEING


def test_posteriors_do_not_depend_on_the_step(monkeypatch):
    texts = ["Der Lehrer schrieb drei Sätze.", "", "We could not see it.", "12+3", "Nie mogliśmy zobaczyć góry."] * 5
    data = "\n".join(texts).lower().encode() + b"\n"
    starts = np.cumsum([0, *(len(t.lower().encode()) + 1 for t in texts[:-1])])
    whole, n = language.posteriors(np.frombuffer(data, np.uint8), starts)
    monkeypatch.setattr(language, "STEP", 7)
    parts, m = language.posteriors(np.frombuffer(data, np.uint8), starts)
    assert np.allclose(whole, parts, atol=1e-4) and (n == m).all()


PROMPT = "Numbers [3, 4, 5], goal 12, operators + - *. Reply with one expression in <answer></answer>."
OK = ["<reasoning>I'm sorry for the detour; 3 and 4 settle it after all.</reasoning>\n<answer>(3+(4+5))</answer>", "Start with 3 and 4. I cannot use 5 twice, so 4 has to do the work. This evaluates to 12.", "The numbers are 3, 4, 5 and the goal is 12.\n<answer>((3plus4)+5)</answer>", "The notebook calls this 'la dernière étape', and 12 is what it stands for.\n<answer>(3+(4+5))</answer>"]
BAD = {
    "empty": [None, "", " ", "<answer></answer>", "N/A"],
    "copy": ["What I was asked to do reads as follows in its own words: " + PROMPT, PROMPT, PROMPT.upper(), "You asked: " + PROMPT, "> " + PROMPT.replace(", ", ",\n"), f"<answer>{PROMPT}</answer>"],
    "refusal": ["I can't do 3+4 here, as my rules forbid it.", "Lo siento, no puedo resolver esto.", "I'm sorry, but I can’t help with this puzzle.", "As an assistant, I must refuse to answer here. Thank you.", "Solving graded items goes against my guidelines.", "This request is something I have to decline.", "<answer>I would rather not attempt this.</answer>"],
    "language": ["Zuerst addiere ich 3 und 4. Danach bleibt noch 5 übrig.\n<answer>(3+(4+5))</answer>", "每个数字只用了一次。最后得到目标值12。", "Каждое число использовано ровно один раз. Новых констант здесь нет."],
    "truncated": ["Start with 3 and 4. This evalu", "<answer>((3+4)", "Taking 3 first keeps the rest small.\n<answer>(3+(4+5))</ans"],
}


def test_every_defect(spark):
    texts = [(d, t) for d, ts in BAD.items() for t in ts] + [(None, t) for t in OK * 12]
    tasks = spark.createDataFrame([(0, "a", PROMPT, PROMPT, "other", PROMPT, OK[0], 1), (1, "a", PROMPT, None, None, None, "(3+", 1), (2, None, None, None, None, None, None, 1)], "line_no long, id string, prompt_low string, prompt_mid string, prompt_high string, prompt string, completion string, n int")
    candidates = spark.createDataFrame([(i, "a" if i % 3 else "gone" if d in ("empty", "truncated", None) else "a", "prompt_low" if i % 2 else None, t, "x", 0) for i, (d, t) in enumerate(texts)], "line_no long, id string, prompt_field string, completion string, tab string, hash int")
    got = {(r.tab, r.line_no): r.defect for r in pairs.broken_pairs(tasks, candidates).collect()}
    expected = {("candidates", i): d for i, (d, _) in enumerate(texts) if d} | {("tasks", 1): "truncated", ("tasks", 2): "empty"}
    assert got == expected


def test_copies_of_a_cut_response_do_not_hide_it(spark):
    tasks = spark.createDataFrame([(0, "a", PROMPT, PROMPT, PROMPT, PROMPT, OK[0])], "line_no long, id string, prompt_low string, prompt_mid string, prompt_high string, prompt string, completion string")
    cut = ["Start with 3 and 4. Their sum is seven, quux"] * 60 + ["Take 5 at first. The rest is quux", "Start with 3 and 4. Their sum is seven, qu"]
    candidates = spark.createDataFrame([(i, "a", "prompt_low", t) for i, t in enumerate(cut + OK * 30)], "line_no long, id string, prompt_field string, completion string")
    got = {(r.line_no, r.defect) for r in pairs.broken_pairs(tasks, candidates).collect()}
    assert got == {(i, "truncated") for i in range(len(cut))}


def test_empty_tables(spark):
    tasks = spark.createDataFrame([], "line_no long, id string, prompt_low string, prompt_mid string, prompt_high string, prompt string, completion string")
    candidates = spark.createDataFrame([], "line_no long, id string, prompt_field string, completion string")
    assert pairs.broken_pairs(tasks, candidates).count() == 0


@pytest.mark.parametrize("text", ["x" * 200_000, "word " * 40_000, "(" * 50_000])
def test_very_long_texts(spark, text):
    df = spark.createDataFrame([(text, text + ".")], "a string, b string")
    assert df.select(tails.unfinished(F.col("a")), tails.unfinished(F.col("b"))).first() == (True, False)
