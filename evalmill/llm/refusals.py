"""Whether a response declines its task: naive Bayes over the words and pairs of words of its sentences.

The classifier is fitted on the built-in sentences below only (at most ``MOST_SENTENCES``). A response declines if one of
its sentences does and no other sentence offers an expression.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

from evalmill.llm.language import SEEDS

#: Bound of the sample that the classifier is fitted on.
MOST_SENTENCES = 1000
#: Smoothing of the counts, and the prior log-odds that a sentence declines.
SMOOTHING, PRIOR = 0.3, -3.0
#: A last sentence that breaks off needs log-odds of this much more, since what follows may turn it.
BROKEN_OFF = 6.0

#: Training sentences that decline, written for this purpose.
DECLINING = """
I can't help with this puzzle. I cannot help you with that request. I'm sorry, but I can't assist with that. I can't answer this question. I cannot provide a solution. I am unable to provide a solution. I am unable to help with this task. I'm not able to solve tasks of this kind.
I am not able to answer that. I won't be giving an expression for this one. I won't answer this. I will not be giving an answer here. I will not do this exercise for you. I would rather not attempt this. I would rather not do this. I'd rather not answer. I prefer not to answer.
I'd prefer not to take part in this. I do not feel comfortable working this out. I don't feel comfortable doing this. I am not comfortable answering this. I must refuse to answer here. I have to refuse this request. I refuse to do this. I must decline. I have to decline this request.
This request is something I have to decline. This is something that I must refuse. I decline to answer. I respectfully decline to solve it. Solving graded items goes against my guidelines. That goes against my policy. This is against our rules. Doing that would violate my guidelines. My guidelines do not allow me to do this.
My instructions forbid it. My policy prevents me from solving this. Helping with checked exercises is outside what I may do. This is beyond what I am allowed to do. That is outside of what I can do. It is not something I can help with. That's not something I'm able to do. I'm not allowed to solve graded work.
I am not permitted to give solutions. I may not answer questions of this kind. I'm afraid I can't do that. I'm afraid that I cannot help. Unfortunately, I can't comply with this request. I cannot comply. I can't complete this task. I can't continue with this. I cannot support this request. I can't share an answer to that.
I cannot offer a solution here. I'm going to have to pass on this one. I'll pass on this one. I have to pass on this. I don't want to do this. I do not wish to answer. No, I will not solve this. I can't give you an answer. I could not possibly answer that. We cannot help with this. We are unable to assist. This assistant cannot answer it.
This assistant is unable to help. As an assistant, I can't help with this. As a language model, I cannot do that. You will have to find someone else to solve it. Please ask a teacher instead of me, as I will not answer. It would not be right for me to solve this. It would be inappropriate for me to answer. I choose not to respond. I can't in good conscience solve this.
Answering this is not possible for me. Giving the answer away is not allowed. I am declining this task. I'm refusing to answer. There is nothing I can do for you here. I must turn this down. I have decided not to solve it. Sorry, no can do. I can't work this out for you. I won't work on this problem. I won't help with homework.
Ich kann dabei nicht helfen. Ich kann diese Aufgabe nicht lösen. Ich kann Ihnen leider nicht helfen. Leider kann ich diese Anfrage nicht beantworten. Ich darf darauf nicht antworten. Ich muss das ablehnen. Ich lehne diese Anfrage ab. Das verstößt gegen meine Richtlinien. Ich möchte diese Aufgabe nicht bearbeiten. Ich bin nicht in der Lage, das zu beantworten. Dabei darf ich nicht helfen. Tut mir leid, das kann ich nicht machen. Ich werde diese Aufgabe nicht lösen.
Je ne peux pas vous aider. Je ne peux pas répondre à cette question. Je suis désolé, mais je ne peux pas aider. Je refuse de répondre. Je dois refuser cette demande. Je ne suis pas en mesure de fournir une solution. Cela va à l'encontre de mes règles. Je préfère ne pas répondre. Je ne suis pas autorisé à résoudre cet exercice. Malheureusement, je ne peux pas résoudre ce problème. Je ne souhaite pas faire cet exercice.
No puedo ayudarte con esto. No puedo ayudar con esta tarea. Lo siento, pero no puedo responder a esta pregunta. No puedo resolver este problema. Debo rechazar esta solicitud. Me niego a responder. No estoy autorizado a dar la respuesta. Va en contra de mis normas. Prefiero no contestar. No me es posible ofrecer una solución. Lamentablemente no puedo hacer eso. No voy a resolver este ejercicio.
Não posso ajudar com isso. Não posso responder a esta pergunta. Desculpe, mas não posso ajudar. Não consigo fornecer uma solução. Tenho de recusar este pedido. Recuso-me a responder. Isso vai contra as minhas regras. Prefiro não responder. Não estou autorizado a resolver este exercício. Não vou resolver isto.
Non posso aiutarti con questo. Non posso rispondere a questa domanda. Mi dispiace, ma non posso aiutare. Devo rifiutare questa richiesta. Mi rifiuto di rispondere. Non sono autorizzato a risolvere questo esercizio. Va contro le mie regole. Preferisco non rispondere. Non sono in grado di fornire una soluzione.
Ik kan hier niet bij helpen. Ik kan deze vraag niet beantwoorden. Het spijt me, maar ik kan niet helpen. Ik moet dit verzoek weigeren. Ik weiger te antwoorden. Dat gaat tegen mijn richtlijnen in. Ik mag deze opgave niet oplossen. Ik wil deze opdracht liever niet doen.
Nie mogę w tym pomóc. Nie mogę odpowiedzieć na to pytanie. Przykro mi, ale nie mogę pomóc. Muszę odmówić. Odmawiam odpowiedzi. To jest sprzeczne z moimi zasadami. Nie wolno mi rozwiązywać takich zadań. Wolę nie odpowiadać. Nie jestem w stanie podać rozwiązania.
Я не могу помочь с этим. Я не могу ответить на этот вопрос. Извините, но я не могу помочь. Я вынужден отказаться. Я отказываюсь отвечать. Это противоречит моим правилам. Мне нельзя решать такие задачи. Я предпочитаю не отвечать. Я не в состоянии дать решение.
"""
#: Training sentences that work on a task, with words that those above use too.
WORKING = """
I cannot use 5 twice, so 4 has to do the work. I can't reach it with 3 alone. We cannot divide evenly here, so addition comes next. It is not possible to divide evenly here. I'm sorry for the detour; 3 and 4 settle it after all. Sorry, that was off by 3; let me redo the step. I apologize for the mistake above. My apologies, the sign was wrong. Unfortunately, that is too large. Unfortunately, 12 is off by one.
I am not able to use 7 here, since it is taken. I could not find a way without 9, so I try another bracket. I won't need the last number until the end. I will not touch 8 yet. I would rather begin with the largest number. I prefer to start with 6. I must not use a number twice. I have to use every number once. I have to add 4 first. I must take 2 away. Let me help myself with a list.
Thank you for the puzzle. Thank you for understanding the detour. You may want to check the sum. You may want to try a calculator. Please ask if a step is unclear. Let me know if another way works for you. Is there anything else to combine? Is there anything else you need? Let me know if another topic works for you. Please ask a teacher instead. Each number has been used once by now. The gap to the goal is now 6.
No constant besides the listed ones is brought in. The operators + - * are all that is allowed. Only the given operators are allowed. This is allowed by the rules. The rules do not allow other numbers. The task asks for one expression. I can answer this with 3 and 4. I can solve this in two steps. I can help with the sum. I am able to reach the goal. The solution is below. Here is an answer. The answer is 12.
Everything is used, and the result is 30. I do not see another way. I don't know yet whether 5 fits. I do not feel sure about the sign, so I check it. It does not work with 3. That would not be right, so I go back. This cannot be right. The value can't be negative. That is not possible with these numbers. There is no other way. Two candidates remain. Nothing is left over.
No, that does not work. No, 14 is too large. We are not done yet. This attempt fails. I turn it around. I pass 7 to the last step. The notebook calls this the last stage, and 4 is what it stands for. Trying 20 minus 9 overshoots, so I turn it around. Working backwards from 12, the last step must involve 3. Helping numbers are 2 and 3. Solving this takes two steps. Working this out gives 9. I will give the expression now. I am giving one expression.
Ich kann 5 nicht zweimal verwenden. Das geht nicht auf, also addiere ich. Leider ist das zu groß. Tut mir leid, der Schritt war falsch. Ich muss noch 3 abziehen. Das ist nicht möglich mit 4. Ich löse die Aufgabe in zwei Schritten. Die Antwort lautet 12.
Je ne peux pas utiliser 5 deux fois. Ce n'est pas possible avec 4. Désolé, l'étape était fausse. Je dois encore soustraire 3. La réponse est 12. Malheureusement, c'est trop grand. Je résous le problème en deux étapes.
No puedo usar el 5 dos veces. No es posible con 4. Lo siento, el paso era falso. Debo restar 3. La respuesta es 12. Lamentablemente es demasiado grande. Resuelvo el problema en dos pasos.
Não posso usar o 5 duas vezes. Não é possível com 4. Desculpe, o passo estava errado. Tenho de subtrair 3. A resposta é 12. Non posso usare il 5 due volte. Non è possibile con 4. Devo ancora togliere 3. La risposta è 12. Ik kan 5 niet twee keer gebruiken. Het kan niet met 4. Ik moet nog 3 aftrekken. Het antwoord is 12.
Nie mogę użyć 5 dwa razy. To niemożliwe z 4. Muszę jeszcze odjąć 3. Odpowiedź to 12. Я не могу использовать 5 дважды. Это невозможно с 4. Нужно ещё вычесть 3. Ответ равен 12.
"""

_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+|</?\w+>")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|\d+")
_NUMBER = re.compile(r"\d+")
_EXPRESSION = re.compile(r"[\d)]\s*[-+*/×÷−]\s*[\d(]")


def sentences(text: str) -> list[str]:
    return [s for part in _SENTENCE.split(text) if (s := part.strip())]


def features(sentence: str) -> set[str]:
    """Words and pairs of words of a sentence, numbers alike."""
    words = ["0" if w[0].isdigit() else w for w in _WORD.findall(sentence.lower().translate(_QUOTES))]
    return {*words, *(f"{a} {b}" for a, b in zip(["^", *words], words, strict=False))}


_QUOTES = {ord("’"): "'", ord("ʼ"): "'"}


@functools.cache
def weights() -> dict[str, float]:
    """Log-odds of each known feature."""
    declining, working = sentences(DECLINING), [*sentences(WORKING), *(s for t in SEEDS.values() for s in sentences(t))]
    if len(declining) + len(working) > MOST_SENTENCES:
        raise ValueError(f"more than {MOST_SENTENCES} training sentences")
    yes, no = (Counter(f for s in group for f in features(s)) for group in (declining, working))
    n, m = len(declining), len(working)
    return {f: math.log((yes[f] + SMOOTHING) / (n + 2 * SMOOTHING)) - math.log((no[f] + SMOOTHING) / (m + 2 * SMOOTHING)) for f in yes | no}


@functools.lru_cache(20_000)
def log_odds(sentence: str) -> float:
    """Log-odds that a sentence declines; features that no training sentence has tell nothing. Numbers are alike."""
    known = weights()
    return PRIOR + sum(known.get(f, 0.0) for f in features(sentence))


def declines(text: str | None, broken_off: bool = False) -> bool:
    """Whether a sentence of a text declines and no other one offers an expression; false for null and empty texts.

    ``broken_off``: the text stops inside its last sentence.
    """
    parts = sentences(text or "")
    refused = offered = False
    for k, s in enumerate(parts, 1):
        if log_odds(_NUMBER.sub("0", s)) > (BROKEN_OFF if broken_off and k == len(parts) else 0):
            refused = True
        elif _EXPRESSION.search(s):
            offered = True
    return refused and not offered
