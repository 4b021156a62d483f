import pytest

from tkanyna.llm.answers import common, declines, defect, defects, shingle_containment
from tkanyna.llm.words import words

PROMPT = "Поки Данило справді оцінив вовняну сорочку, Макар не побачив барвисту хустку біля села Смотарівка."
ANSWER = "Поки Данило справді оцінив вовнєну сорочку, Макар ни побачив барвисту хустку коло села Смотарівка."
CASES = [
    (PROMPT, None, "empty"), (PROMPT, "", "empty"), (PROMPT, "  ​…-", "empty"), (PROMPT, "«»", "empty"),
    (PROMPT, PROMPT, "copy"), (PROMPT, PROMPT.upper(), "copy"), (PROMPT, f"Ось переклад: «{PROMPT}»", "copy"), (PROMPT, PROMPT.replace("о", "o").replace(" ", "  "), "copy"), (PROMPT, "1. " + PROMPT, "copy"), ("26. " + PROMPT, "26.  " + PROMPT, "copy"), ("26. " + PROMPT, PROMPT.lower(), None), ("26. " + PROMPT, "3) " + PROMPT, "copy"),
    (PROMPT, "На жаль, я не можу виконати цей запит.", "refusal"), (PROMPT, "Sorry, I can't help with that. «Поки Данило справді оцінив вовняну…»", "refusal"), (PROMPT, "К сожалению, я не могу перевести это предложение.", "refusal"),
    (PROMPT, "Przepraszam, ale nie mogę tego przetłumaczyć.", "refusal"), (PROMPT, "Îmi pare rău, nu pot ajuta.", "refusal"), (PROMPT, "Запит відхилено.", "refusal"),
    (PROMPT, "My cousin painted the small bridge.", "other_language"), (PROMPT, "Лесник продал новое ведро", "other_language"), (PROMPT, "Cichy nauczyciel opisał mały most!", "other_language"),
    (PROMPT, ANSWER[:60], "truncated"), (PROMPT, "<SEP>" + ANSWER[:60], "truncated"), (PROMPT, ANSWER, None), (PROMPT, f'2. "{ANSWER}" <SEP>', None), (PROMPT, ANSWER[:-1], None), (None, ANSWER, None), (None, None, "empty"),
    ("Мені прикро, проте неможливо продати стару хату.", "Мені прикру, єнак неможливу продати стару хату.", None), ("Слово", "Слово", "copy"), ("", "My cousin hid it", "other_language"),
]


@pytest.mark.parametrize(("prompt", "answer", "kind"), CASES)
def test_kinds(prompt, answer, kind):
    assert defect(prompt, answer) == kind


def test_operator(spark):
    rows = [(i, a, b, "x", "y") for i, (a, b, _) in enumerate(CASES)]
    df = spark.createDataFrame([*rows, *rows, (None, "a", None, "x", "y")], "record_id bigint, p string, r string, defect string, row string")
    got = [tuple(r) for r in defects(df, "record_id", "p", "r").collect()]
    assert sorted(got) == [(i, k) for i, (_, _, k) in enumerate(CASES) if k]
    assert defects(df.limit(0), "record_id", "p", "r").count() == 0


def test_containment_and_long_texts():
    assert shingle_containment("а б в г".split(), "х а б в г".split()) == 1.0 and shingle_containment([], ["а"]) == 0.0
    long = " ".join(f"слово{i}х" for i in range(20_000))
    assert defect(long, long) == "copy" and defect(long, long[:90_000]) == "truncated"


def test_copies_behind_long_lead_ins():
    prompt = "Поки Данило справді оцінив вовняну сорочку, Макар не побачив барвисту хустку біля села Смотарівка."
    said = "Поки Данило справді оцінив вовнєну сорочку, Макар ни побачив барвисту хустку коло села Смотарівка."
    lead = "Добрий день, шановні колеги, ось тут нижче подаю вам готову відповідь, яку ви просили:"
    assert defect(prompt, f"{lead} {prompt}") == defect(prompt, f"{prompt} {lead}") == defect(prompt, f"{lead} {lead} {prompt}") == "copy"
    assert defect(prompt, f"{prompt} {prompt} {prompt}") == "copy"
    assert defect(prompt, f"{prompt} {said}") is None and defect(prompt, f"{prompt} {lead} {said}") is None
    assert defect(prompt, f"Вибачте, але з огляду на наші правила та умови роботи я не можу перекласти речення «{prompt}»") == "refusal"
    assert defect("Так", f"{lead} так") != "copy"


HELD_OUT = """Вибачте, але цей текст я перекладати відмовлюся
Таке прохання суперечить моїм принципам і правилам роботи
На жаль, виконати таке прохання мені не дозволяють правила.
Я утримаюся від перекладу цього речення.
Цей запит виходить за межі моїх можливостей.
Я змушений відхилити ваше прохання.
Перекладати подібні речення я не берусь.
Мені не дозволено працювати з таким змістом.
Цей матеріал заборонено перекладати.
Пробачте, та допомогти тут я ніяк не зможу.
Не маю дозволу обробляти такий текст.
Я не готовий виконати це завдання.
Ваш запит порушує наші умови використання.
I regret to say that I must decline this request.
This request goes against my guidelines.
I have to refuse to answer.
That is outside the scope of what I do.
Translation is not possible for this input.
Your prompt was rejected by our safety policy.
We do not provide translations of such content.
Простите, но я вынужден отказаться переводить этот текст.
Ваш запрос противоречит нашим правилам.
Этот текст я переводить не буду.
Niestety nie potrafię przetłumaczyć tego zdania.
Ta prośba narusza zasady korzystania.
Muszę odmówić wykonania tego polecenia.
Acest conținut încalcă regulile noastre.
Ich muss diese Anfrage leider ablehnen.""".split("\n")
NO_REFUSALS = """Мама мала раму поза хатов
Козак переписав весло для хлопця, а дощ не переставав цілий день.
Дід не мав коли сходити до крамниці, але онука все купила.
Правила гри були прості, та ніхто їх не читав.
Він не буде нині косити, бо трава мокра.
The old miller sold the blue kerchief behind the chapel and a young shepherd described it.
My cousin did not sell the wooden chest.
Stary młynarz nie pożyczył leśnych jagód zeszłej zimy.
Вибачте, чи далеко до Верховини?
Прохання про дощ почули, і вранці полило.""".split("\n")


def test_refusals_are_aligned_with_gaps():
    assert sum(declines(words(t)) for t in HELD_OUT) >= 0.9 * len(HELD_OUT)
    assert not [t for t in NO_REFUSALS if declines(words(t))]
    assert declines("я не хочу і сьогодні точно не можу".split()) and not declines("не було а потім ще дуже довго нічого такого не казали що хтось можливо можу".split()[:12])
    assert not declines([]) and declines(["слово"] * 20_000 + ["не", "можу"])


def test_the_language_is_told_by_the_corpus(spark, folder):
    corpus = spark.read.parquet(f"{folder}/jsonl_corpus.parquet").select("record_id", "source_standard", "generated_dialect")
    extra = [(-1, PROMPT, "Мама мала раму поза хатов"), (-2, PROMPT, "Старый возница продал медный колокол у реки"), (-3, PROMPT, "Тихий учитель спрятал медный котел перед грозой")]
    rows = corpus.unionByName(spark.createDataFrame(extra, corpus.schema))
    got = {r.record_id: r.defect for r in defects(rows, "record_id", "source_standard", "generated_dialect").filter("record_id < 0").collect()}
    assert got == {-2: "other_language", -3: "other_language"}


def test_longest_common_subsequences():
    assert common("а б в г".split(), "х а ц б г".split()) == 3 and common([], ["а"]) == common(["а"], []) == 0
    assert common(list("абаб") * 50, list("баба") * 50) == 199
