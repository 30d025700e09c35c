"""Languages in one script, learned refusals, and words that are cut."""

import pytest

from rankmill.llm import pairs

LABELLED = [
    ("en", "the file is read once and then the loop ends before the queue is called with the names of the rows that were kept"), ("en", "without this setting the list grows until there is no memory left and the worker stops with an error"),
    ("de", "die Datei wird nur einmal gelesen und danach endet die Schleife, bevor die Warteschlange mit den Namen aufgerufen wird"), ("de", "ohne diese Einstellung wächst die Liste, bis kein Speicher mehr da ist und der Vorgang abbricht"),
    ("es", "el archivo se lee una sola vez y después termina el bucle antes de que se llame a la cola con los nombres de las filas"), ("es", "sin este valor la lista crece hasta que no queda memoria y el proceso se detiene con un error según el manual"),
    ("pt", "o arquivo é lido uma única vez e depois o laço termina antes que a fila seja chamada com os nomes das linhas"), ("pt", "sem esta configuração a lista cresce até não haver mais memória e o processo para com um erro segundo o manual"),
    ("ru", "файл читается только один раз, а затем цикл заканчивается раньше, чем будет вызвана очередь с именами строк"), ("ru", "без этой настройки список растёт, пока не кончится память, и процесс останавливается с ошибкой"),
    ("ar", "يقرأ الملف مرة واحدة فقط ثم تنتهي الحلقة قبل استدعاء قائمة الانتظار بأسماء الصفوف"), ("ar", "بدون هذا الإعداد تكبر القائمة حتى تنفد الذاكرة وتتوقف العملية مع خطأ كما في الدليل"),
]


@pytest.fixture(scope="module")
def model():
    return pairs.Languages.fit(LABELLED)


@pytest.mark.parametrize("question, answer, want", [
    ("Почему список растёт после вызова?", "Без цього налаштування список росте, поки є пам'ять, і процес зупиняється з помилкою її власника", True),
    ("Почему список растёт после вызова?", "Список растёт, пока не кончится память", False),
    ("لماذا تكبر القائمة بعد الاستدعاء؟", "پرونده تنها یک بار خوانده می‌شود و سپس حلقه پیش از فراخوانی صف پایان می‌یابد", True),
    ("لماذا تكبر القائمة بعد الاستدعاء؟", "تكبر القائمة حتى تنفد الذاكرة", False),
    ("Por qué termina el bucle antes de que se lea el archivo?", "O laço termina antes que a fila seja chamada com os nomes das linhas", True),
    ("Por qué termina el bucle antes de que se lea el archivo?", "El bucle termina antes según el manual y la lista crece", False),
    ("Why does f_x end before the queue is called?", "Het bestand wordt maar een keer gelezen en daarna stopt de lus zonder de wachtrij aan te roepen", True),
    ("Why does “Größe wird gelesen” end the loop?", "The loop ends before the queue is called with the names", False),
    ("Why does f_x end?", "It prints „die Datei wird nur einmal gelesen und danach endet die Schleife“ and ends", False),
    ("Why does f_x end?", "读取一次文件", True), ("Why does f_x end?", "g_y(3)", False), ("", "El bucle termina", False),
])
def test_languages(model, question, answer, want):
    assert pairs.differs(model, question, answer, pairs.Settings().sure) is want


def test_learned_refusals_and_pieces(spark):
    """Forms that deny and only stand alone are refusals, whatever their words; those met among others, or giving something, are not."""
    j = lambda *texts: "[" + ", ".join('{"text": "%s", "citations": [1]}' % t for t in texts) + "]"
    rows, want = [], set()

    def add(*texts, defect=None):
        i = len(rows)
        rows.append((i, f"How do I call f_{i} from g_{i} in the loop?", j(*texts), " ".join(t + "." for t in texts)))
        if defect:
            want.add((i, defect))

    for k in range(30):
        add(f"You cannot call a_{k} twice", f"The loop ends with b_{k} after the process")
        add(f"The loop ends with c_{k} after the process")
        add(f"Over d_{k} staat niets in de bronnen", defect="refusal")
        add(f"Nothing at hand touches on e_{k}", defect="refusal")
        add(f"The notes are not about h_{k}, but they show that i_{k} must run before the loop ends")
        add(f"Yes, k_{k}")
        add(f"You cannot call l_{k} twice")
    for k in range(3):
        add(f"The loop ends with m_{k} after the process", f"The loop ends with n_{k} after the pro", defect="truncated")
    rows = [(i, q, c, a[:-1] if (i, "truncated") in want else a) for i, q, c, a in rows]
    df = spark.createDataFrame(rows, "query_id long, query_text string, claims_json string, answer string")
    got = {tuple(r) for r in pairs.find_defects(df, spark.createDataFrame([], "lang string, text string")).collect()}
    assert got == want
