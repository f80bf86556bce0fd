"""Language posteriors from naive Bayes over byte trigrams of letters, computed for whole batches at once."""

from __future__ import annotations

import functools

import numpy as np

#: Training text of each language, written for this purpose; the only data that the classifier is fitted on.
SEEDS = {
    "en": "This is the text of a short letter about numbers and words. We start with the first number and add the second one to it. After that the rest of the work is easy, because each of the numbers has been used only once. You may ask why the answer is not larger than the goal. The reason is simple: what is left over must be taken away again. Please check every step before you write the final result, and do not bring in anything that was not given. If you cannot find a way, try to work backwards from the target value. Here is an example of how it can be done, with the brackets in the right place. Let me think about which of these should come next. They have to be combined so that nothing is missing. Hence the expression reaches the value that we need. Give one reply with the operators that are allowed, then stop. Working this out takes some time, but it makes sense to look at the gap that remains on the left and on the right.",
    "de": "Dies ist der Text eines kurzen Briefes über Zahlen und Wörter. Wir beginnen mit der ersten Zahl und zählen die zweite dazu. Danach ist der Rest der Arbeit leicht, weil jede der Zahlen nur einmal verwendet wurde. Man kann fragen, warum die Antwort nicht größer als das Ziel ist. Der Grund ist einfach: was übrig bleibt, muss wieder abgezogen werden. Bitte prüfe jeden Schritt, bevor du das Ergebnis aufschreibst, und füge nichts hinzu, was nicht gegeben war. Wenn du keinen Weg findest, dann gehe rückwärts vom gesuchten Wert aus. Hier ist ein Beispiel, wie es gemacht werden kann, mit den Klammern an der richtigen Stelle. Damit erreichen wir genau den Wert, den wir brauchen. Es fehlt noch ein Stück, und die anderen schließen die Lücke.",
    "fr": "Voici le texte d'une courte lettre sur les nombres et les mots. Nous commençons par le premier nombre et nous lui ajoutons le deuxième. Après cela, le reste du travail est facile, car chacun des nombres n'a été utilisé qu'une seule fois. On peut demander pourquoi la réponse n'est pas plus grande que le but. La raison est simple : ce qui reste doit être retiré de nouveau. Veuillez vérifier chaque étape avant d'écrire le résultat final, et n'ajoutez rien qui n'ait été donné. Si vous ne trouvez pas de chemin, essayez de partir de la valeur cherchée. Voilà un exemple avec les parenthèses à la bonne place. Nous obtenons ainsi la valeur dont nous avons besoin, et il ne manque plus rien dans cette expression.",
    "es": "Este es el texto de una carta breve sobre números y palabras. Empezamos con el primer número y le sumamos el segundo. Después de eso el resto del trabajo es fácil, porque cada uno de los números se ha usado una sola vez. Se puede preguntar por qué la respuesta no es mayor que la meta. La razón es sencilla: lo que sobra hay que quitarlo otra vez. Por favor, comprueba cada paso antes de escribir el resultado final, y no añadas nada que no se haya dado. Si no encuentras un camino, intenta ir hacia atrás desde el valor buscado. Aquí hay un ejemplo con los paréntesis en su lugar. Así llegamos al valor que necesitamos, y todavía queda algo por hacer con los demás.",
    "pt": "Este é o texto de uma carta curta sobre números e palavras. Começamos com o primeiro número e somamos o segundo a ele. Depois disso o resto do trabalho é fácil, porque cada um dos números foi usado apenas uma vez. Pode-se perguntar por que a resposta não é maior do que o objetivo. A razão é simples: o que sobra tem de ser retirado outra vez. Por favor, verifique cada passo antes de escrever o resultado final, e não acrescente nada que não tenha sido dado. Se não encontrar um caminho, tente ir para trás a partir do valor pedido. Aqui está um exemplo com os parênteses no lugar certo. Assim chegamos ao valor de que precisamos, e ainda faltam outros números.",
    "it": "Questo è il testo di una breve lettera sui numeri e sulle parole. Cominciamo con il primo numero e gli aggiungiamo il secondo. Dopo di che il resto del lavoro è facile, perché ciascuno dei numeri è stato usato una volta sola. Si può chiedere perché la risposta non sia più grande dell'obiettivo. La ragione è semplice: quello che avanza deve essere tolto di nuovo. Per favore, controlla ogni passo prima di scrivere il risultato finale, e non aggiungere nulla che non sia stato dato. Se non trovi una strada, prova ad andare indietro dal valore cercato. Ecco un esempio con le parentesi al posto giusto. Così si arriva al valore che ci serve, e non manca più nessuna cifra.",
    "nl": "Dit is de tekst van een korte brief over getallen en woorden. Wij beginnen met het eerste getal en tellen het tweede erbij op. Daarna is de rest van het werk gemakkelijk, omdat elk van de getallen maar een keer is gebruikt. Men kan vragen waarom het antwoord niet groter is dan het doel. De reden is eenvoudig: wat overblijft moet weer worden weggenomen. Controleer alsjeblieft elke stap voordat je de uitkomst opschrijft, en voeg niets toe dat niet gegeven was. Als je geen weg vindt, probeer dan terug te gaan vanaf de gezochte waarde. Hier is een voorbeeld met de haakjes op de juiste plaats. Zo komen we precies bij de waarde die we nodig hebben, en er ontbreekt niets meer.",
    "pl": "To jest tekst krótkiego listu o liczbach i słowach. Zaczynamy od pierwszej liczby i dodajemy do niej drugą. Potem reszta pracy jest łatwa, ponieważ każda z liczb została użyta tylko jeden raz. Można zapytać, dlaczego odpowiedź nie jest większa niż cel. Powód jest prosty: to, co zostaje, trzeba znowu odjąć. Proszę sprawdzić każdy krok przed zapisaniem wyniku końcowego i nie dodawać niczego, czego nie podano. Jeśli nie znajdziesz drogi, spróbuj iść wstecz od szukanej wartości. Oto przykład z nawiasami we właściwym miejscu. W ten sposób dochodzimy do wartości, której potrzebujemy, i niczego już nie brakuje.",
    "cs": "Toto je text krátkého dopisu o číslech a slovech. Začneme prvním číslem a přičteme k němu druhé. Potom je zbytek práce snadný, protože každé z čísel bylo použito jen jednou. Lze se ptát, proč odpověď není větší než cíl. Důvod je prostý: co zbývá, musí se zase odečíst. Prosím zkontrolujte každý krok, než napíšete konečný výsledek, a nepřidávejte nic, co nebylo zadáno. Když nenajdete cestu, zkuste jít zpět od hledané hodnoty. Zde je příklad se závorkami na správném místě. Takto dojdeme k hodnotě, kterou potřebujeme, a už nic nechybí.",
    "sv": "Det här är texten i ett kort brev om tal och ord. Vi börjar med det första talet och lägger till det andra. Efter det är resten av arbetet lätt, eftersom vart och ett av talen bara har använts en gång. Man kan fråga varför svaret inte är större än målet. Skälet är enkelt: det som blir över måste tas bort igen. Var snäll och kontrollera varje steg innan du skriver ner resultatet, och lägg inte till något som inte var givet. Om du inte hittar någon väg, försök att gå baklänges från det sökta värdet. Här är ett exempel med parenteserna på rätt plats.",
    "tr": "Bu, sayılar ve sözcükler üzerine kısa bir mektubun metnidir. İlk sayıyla başlıyoruz ve ikincisini ona ekliyoruz. Bundan sonra işin geri kalanı kolaydır, çünkü sayıların her biri yalnızca bir kez kullanıldı. Cevabın neden hedeften büyük olmadığı sorulabilir. Nedeni basit: artan şey yeniden çıkarılmalıdır. Lütfen sonucu yazmadan önce her adımı denetleyin ve verilmemiş olan hiçbir şeyi eklemeyin. Bir yol bulamazsanız, aranan değerden geriye doğru gitmeyi deneyin. Parantezlerin doğru yerde olduğu bir örnek burada.",
    "ru": "Это текст короткого письма о числах и словах. Мы начинаем с первого числа и прибавляем к нему второе. После этого остальная работа легка, потому что каждое из чисел было использовано только один раз. Можно спросить, почему ответ не больше цели. Причина проста: то, что остаётся, нужно снова вычесть. Пожалуйста, проверьте каждый шаг, прежде чем записать окончательный результат, и не добавляйте ничего, что не было дано. Если вы не находите пути, попробуйте идти назад от искомого значения. Вот пример, где скобки стоят на своём месте. Таким образом мы получаем нужное значение.",
    "uk": "Це текст короткого листа про числа і слова. Ми починаємо з першого числа і додаємо до нього друге. Після цього решта роботи легка, бо кожне з чисел було використано лише один раз. Можна спитати, чому відповідь не більша за мету. Причина проста: те, що залишається, треба знову відняти. Будь ласка, перевірте кожен крок, перш ніж записати остаточний результат, і не додавайте нічого, що не було дано. Якщо ви не знаходите шляху, спробуйте йти назад від шуканого значення. Ось приклад, де дужки стоять на своєму місці.",
    "el": "Αυτό είναι το κείμενο ενός σύντομου γράμματος για αριθμούς και λέξεις. Αρχίζουμε με τον πρώτο αριθμό και του προσθέτουμε τον δεύτερο. Μετά από αυτό η υπόλοιπη δουλειά είναι εύκολη, γιατί κάθε αριθμός χρησιμοποιήθηκε μόνο μία φορά. Ο λόγος είναι απλός: ό,τι περισσεύει πρέπει να αφαιρεθεί ξανά.",
    "zh": "这是一封关于数字和文字的短信。我们先从第一个数字开始,再把第二个数字加上去。之后剩下的工作就很容易,因为每个数字都只用了一次。有人会问,为什么答案没有比目标更大。原因很简单:多出来的部分必须再减掉。请在写下最后结果之前检查每一步,不要加入没有给出的东西。如果找不到办法,可以从目标值往回推。这样就得到我们需要的值,括号放在正确的地方,还差多少也可以算出来。最后得到的目标值是对的,每个数都已经用过,只能用一次。首先把两个数相加,然后减去第三个数,得到的结果就是答案。",
    "ja": "これは数と言葉についての短い手紙の文章です。まず最初の数から始めて、二番目の数を足します。そのあとの作業は簡単です。それぞれの数を一度だけ使ったからです。なぜ答えが目標より大きくないのかと聞かれるかもしれません。理由は単純で、残ったものをもう一度引かなければならないのです。最後の結果を書く前に、すべての手順を確認してください。",
    "ko": "이것은 숫자와 낱말에 대한 짧은 편지의 글입니다. 우리는 첫 번째 수에서 시작하여 두 번째 수를 더합니다. 그 다음에는 나머지 일이 쉽습니다. 각각의 수를 한 번만 사용했기 때문입니다. 이유는 간단합니다. 남는 것은 다시 빼야 합니다. 마지막 결과를 쓰기 전에 모든 단계를 확인해 주세요.",
    "ar": "هذا نص رسالة قصيرة عن الأعداد والكلمات. نبدأ بالعدد الأول ونضيف إليه العدد الثاني. بعد ذلك يكون باقي العمل سهلا لأن كل عدد استعمل مرة واحدة فقط. والسبب بسيط وهو أن ما يبقى يجب أن يطرح من جديد. من فضلك تحقق من كل خطوة قبل أن تكتب النتيجة النهائية.",
}
LANGUAGES = tuple(SEEDS)
BITS = 15
#: Pseudo-counts of each trigram.
SMOOTHING = 0.1
#: Trigrams of one text are alike, so a text of this many counts for half of what they say.
LITTLE = 16
#: Trigrams that are looked up at once.
STEP = 1 << 17

#: Letters and bytes of UTF-8 sequences stay, in lower case; everything else is a gap.
_LETTER = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        _LETTER[_b] = ord(chr(_b).lower())
    elif _b >= 128:
        _LETTER[_b] = _b


def _grams(data: np.ndarray, drop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(trigram buckets, the index in data at which each starts) over letters; runs of gaps count as one gap."""
    folded = _LETTER[data]
    if drop is not None:
        folded[drop] = 0
    letter = folded != 0
    step = np.diff(letter.astype(np.int8), prepend=0, append=0)
    first, after = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(first):  # ASCII letters that touch digits, as in 5plus7 or f(x), belong to expressions
        before, behind = data[np.maximum(first - 1, 0)], data[np.minimum(after, len(data) - 1)]
        digit = lambda x: (x >= 48) & (x <= 57)
        glued = ((digit(before) | (before == 41)) & (first > 0) & (data[first] < 128)) | ((digit(behind) | (behind == 40)) & (after < len(data)) & (data[after - 1] < 128))
        folded[letter] *= np.repeat(~glued, after - first).astype(np.uint8)
        letter = folded != 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    at = np.flatnonzero(keep)
    v = folded[at].astype(np.uint32)
    if len(v) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = v[:-2] | (v[1:-1] << np.uint32(8)) | (v[2:] << np.uint32(16))
    with np.errstate(over="ignore"):
        bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return bucket.astype(np.int64), at[:-2]


@functools.cache
def log_table() -> np.ndarray:
    """Log-probability of each trigram bucket under each language, with Laplace smoothing."""
    counts = np.full((1 << BITS, len(LANGUAGES)), SMOOTHING)
    for k, text in enumerate(SEEDS.values()):
        buckets, _ = _grams(np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8))
        np.add.at(counts[:, k], buckets, 1.0)
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


def posteriors(data: np.ndarray, starts: np.ndarray, drop: np.ndarray | None = None, flatten: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each language, number of trigrams) for each segment of a batch that begins at ``starts``.

    Trigrams overlap, so their log-probabilities are weighted by ``flatten``, and less so the fewer there are; the
    prior is uniform.
    """
    n = len(starts)
    buckets, at = _grams(data, drop)
    scores = np.zeros((n, len(LANGUAGES)), dtype=np.float64)
    row = np.searchsorted(starts, at, "right") - 1
    count = np.bincount(row, minlength=n)
    for s in range(0, len(at), STEP):
        part = row[s : s + STEP]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        scores[part[first]] += np.add.reduceat(log_table()[buckets[s : s + STEP]], first, axis=0)
    scores *= (flatten * count / (count + LITTLE))[:, None]
    scores -= scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    return (p / p.sum(axis=1, keepdims=True)).astype(np.float32), count


def posterior(text: str) -> dict[str, float]:
    """The posterior of each language for one text; uniform for a text without letters."""
    data = np.frombuffer((text.lower() + "\n").encode(), dtype=np.uint8)
    p, _ = posteriors(data, np.zeros(1, np.int64))
    return dict(zip(LANGUAGES, map(float, p[0]), strict=True))
