"""Context, answers, rendering and the streaming forms."""

import json
import re

import pytest
from pyspark.sql import functions as F

from pagelore.config import AnswerConfig, CrawlConfig, EmbedConfig
from pagelore.operators.answering import (
    ChatGenerator,
    ExtractiveGenerator,
    ChatGenerator,
    answer_from_results,
    build_context,
    results_report,
    system_prompt,
)
from pagelore.operators.embedding import HashedWords
from pagelore.operators.points import read_points
from pagelore.operators.render import render_answer
from pagelore.plans.chat import answer_questions
from pagelore.streaming import pages_into_points, questions_into_answers

CFG = AnswerConfig(knowledge_base="toy", max_question_chars=30)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [("q1", " where is the fox? "), ("q2", "nothing found"), ("q3", "  "), ("q4", "x" * 31), ("q5", "blank text"), ("q6", None)]
    return spark.createDataFrame(rows, "query_id string, question string")


@pytest.fixture(scope="module")
def results(spark):
    rows = [("q1", 2, " The fox is here. Bye. "), ("q1", 1, "A dog.\n\nNo cat"), ("q5", 1, "  ")]
    return spark.createDataFrame(rows, "query_id string, pick int, text string")


def test_context(results):
    got = {r.query_id: r for r in build_context(results).collect()}
    assert got["q1"].context == "A dog.\n\nNo cat\n\nThe fox is here. Bye."
    assert (got["q1"].context_chunks, got["q1"].context_chars, got["q1"].context_words) == (2, 37, 9)
    assert got["q5"].context == ""


def test_every_question_gets_a_row(asked, results):
    got = {r.query_id: r for r in answer_from_results(asked, results, ExtractiveGenerator(), CFG).collect()}
    assert {k: r.status_code for k, r in got.items()} == {"q1": 200, "q2": 200, "q3": 400, "q4": 400, "q5": 200, "q6": 400}
    assert got["q1"].answer == "The fox is here." and got["q1"].question == "where is the fox?"
    assert got["q2"].answer == got["q5"].answer == "I couldn't find that information in the toy knowledge base."
    assert got["q3"].answer is None and "empty" in got["q3"].detail and "longer" in got["q4"].detail
    assert CFG.fallback in system_prompt(CFG)


def test_chat_generator_reports_failures_per_question(spark, asked, results):
    def load():
        def ask(system, user, temperature, max_tokens):
            assert "toy" in system and (temperature, max_tokens) == (0.2, 1024)
            if "fail" in user:
                raise TimeoutError("slow")
            return "  " if "blank reply" in user else f" {user[-5:]} "
        return ask

    more = asked.unionByName(spark.createDataFrame([("q7", "fail"), ("q8", "blank reply")], "query_id string, question string"))
    found = results.unionByName(spark.createDataFrame([("q7", 1, "t"), ("q8", 1, "t")], "query_id string, pick int, text string"))
    got = {r.query_id: r for r in answer_from_results(more, found, ChatGenerator(load), CFG).collect()}
    assert got["q1"].answer == "fox?" and got["q2"].answer == CFG.fallback
    assert (got["q7"].status_code, got["q7"].answer) == (500, None) and "TimeoutError: slow" in got["q7"].detail
    assert got["q8"].status_code == 500 and "empty reply" in got["q8"].detail
    with pytest.raises(ValueError):
        ChatGenerator(load).generate(" ", F.lit("x"))


def test_report(spark, asked):
    rows = [("q1", 1, 0.5, 0.25, 0.125, "T", "S", "U", "text")]
    df = spark.createDataFrame(rows, "query_id string, pick int, score double, rerank_score double, mmr_score double,"
                                     " title string, section string, url string, text string")
    got = {r.query_id: r.report for r in results_report(asked, df).collect()}
    assert "Results     : 1" in got["q1"] and "Rank 1\nVector score: 0.5000\nRerank score: 0.2500\nMMR score   : 0.1250" in got["q1"]
    assert "No relevant results found." in got["q2"]


def test_render(evaluate):
    def table(head, *rows):
        cells = lambda tag, vs: "".join(f"<{tag}>{v}</{tag}>" for v in vs)
        return ('<div class="response-table-wrapper"><table class="response-table"><thead><tr>' + cells("th", head) + "</tr></thead><tbody>"
                + "".join("<tr>" + cells("td", r) + "</tr>" for r in rows) + "</tbody></table></div>")

    cases = {
        "": "", None: "",
        "a < b & 'c' \"d\"": "a &lt; b &amp; &#039;c&#039; &quot;d&quot;",
        "x<br>y<BR />z": "x<br>y<br>z",
        "**b** and **c**": "<strong>b</strong> and <strong>c</strong>",
        "- one\n * two\n3. three": '<div class="response-bullet">• one</div><br><div class="response-bullet">• two</div><br>'
                                   '<div class="response-number">3. three</div>',
        "t\n| a | b |\n|---|:-:|\n| 1 | **2** | 3 |\n| 4 |\nend": "t<br>" + table(["a", "b"], ["1", "<strong>2</strong>"], ["4", ""]) + "<br>end",
        "|a|b|\n|-|-|\n|a|b|\n|-|-|": table(["a", "b"], ["a", "b"], ["-", "-"]),
        "|a|b|\n|-|-|\n|1|2|\n\n|c|d|\n|-|-|": table(["a", "b"], ["1", "2"]) + "<br><br>" + table(["c", "d"]),
        "| no | table |": "| no | table |",
        "|a|\n|-|": "|a|<br>|-|",
    }
    assert evaluate(render_answer, list(cases)) == list(cases.values())


def test_streams(spark, tmp_path):
    site = CrawlConfig(canonical_host="www.h.example")
    (tmp_path / "pages").mkdir()
    (tmp_path / "asked").mkdir()

    def put(name, words, folder="pages", n=0):
        html = f"<title>{name}</title><body><h1>{name}</h1><p>{words} {' '.join(f'{name}{i}' for i in range(30))}</p></body>"
        (tmp_path / folder / f"{name}{n}.json").write_text(json.dumps({"url": f"https://www.h.example/{name}", "html": html}))

    enc, path = HashedWords(EmbedConfig(dimension=16)), str(tmp_path / "points")

    def run_pages():
        stream = spark.readStream.schema("url string, html string").json(str(tmp_path / "pages"))
        pages_into_points(stream, path, str(tmp_path / "cp1"), enc, site).awaitTermination(300)

    put("foxes", "the red fox sleeps")
    run_pages()
    assert read_points(spark, path).count() == 1
    put("dogs", "a dog barks")
    put("foxes", "the red fox sleeps", n=1)
    run_pages()
    assert sorted(r.title for r in read_points(spark, path).select("title").collect()) == ["dogs", "foxes"]
    # A page that changed loses its old passages.
    put("foxes", "a grey wolf howls", n=2)
    run_pages()
    assert len(stored := read_points(spark, path).collect()) == 2 and not [r for r in stored if "red fox" in r.text]
    put("foxes", "the red fox sleeps", n=3)
    run_pages()
    (tmp_path / "asked" / "1.json").write_text(json.dumps({"query_id": "q", "question": "where does the red fox sleep"}))
    stream = spark.readStream.schema("query_id string, question string").json(str(tmp_path / "asked"))
    questions_into_answers(stream, path, str(tmp_path / "answers"), str(tmp_path / "cp2"), enc).awaitTermination(300)
    row = spark.read.parquet(str(tmp_path / "answers")).first()
    assert row.query_id == "q" and re.search("red fox", row.answer)
    direct = answer_questions(read_points(spark, path), spark.createDataFrame([("q", " ")], "query_id string, question string"), enc)
    assert direct.first().status_code == 400


def test_a_passage_passes_to_its_next_page(spark, tmp_path):
    site, enc, path = CrawlConfig(canonical_host="www.h.example"), HashedWords(EmbedConfig(dimension=16)), str(tmp_path / "points")
    (tmp_path / "pages").mkdir()
    shared = " ".join(f"shared{i}" for i in range(40))

    def run(n, **texts):
        for name, text in texts.items():
            row = {"url": f"https://www.h.example/{name}", "html": f"<title>t</title><body><h1>t</h1><p>{text}</p></body>"}
            (tmp_path / "pages" / f"{name}{n}.json").write_text(json.dumps(row))
        stream = spark.readStream.schema("url string, html string").json(str(tmp_path / "pages"))
        pages_into_points(stream, path, str(tmp_path / "cp"), enc, site).awaitTermination(300)
        return sorted((r.url.rsplit("/", 1)[1], "shared0" in r.text) for r in read_points(spark, path).collect())

    assert run(1, a=shared) == [("a", True)]
    assert run(2, b=shared) == [("a", True)]
    # The first page changes: the second one still says it.
    assert run(3, a=" ".join(f"new{i}" for i in range(40))) == [("a", False), ("b", True)]
    # A page of which too little is left is not found any more.
    assert run(4, a="thin") == [("b", True)]
    assert run(5, a=shared, b="thin") == [("a", True)]
    # A batch that comes again changes nothing.
    assert run(6, a=shared) == [("a", True)]


def test_a_model_is_asked_once_per_prompt(spark, tmp_path):
    log = str(tmp_path / "calls")

    def load():
        def ask(system, user, **options):
            with open(log, "a") as out:
                out.write("call\n")
            return "fine"

        return ask

    asked = spark.createDataFrame([(str(i), f"question {i}") for i in range(3)], "query_id string, question string")
    found = spark.createDataFrame([(str(i), 1, "some text") for i in range(3)], "query_id string, pick int, text string")
    answers = answer_from_results(asked, found, ChatGenerator(load)).filter("status_code = 200").collect()
    assert len(answers) == 3 and len(open(log).readlines()) == 3


def test_replies_are_paid_for_once(spark, tmp_path):
    log, replies = str(tmp_path / "calls"), str(tmp_path / "replies")

    def load():
        from threading import Lock

        lock, seen = Lock(), set()

        def ask(system, user, **options):
            with lock:
                with open(log, "a") as out:
                    out.write(user[-1] + "\n")
                first = user not in seen
                seen.add(user)
            if user.endswith("9") or (first and user.endswith("1")):
                raise TimeoutError("busy")
            return f"reply {user[-1]}"

        return ask

    def calls():
        return sorted(open(log).read().split())

    # Questions 0 and 5 share a prompt; 1 fails once, 9 always.
    ends = {0: 0, 1: 1, 2: 2, 5: 0, 9: 9}
    asked = spark.createDataFrame([(str(i), f"question {e}") for i, e in ends.items()], "query_id string, question string")
    found = spark.createDataFrame([(str(i), 1, "some text") for i in (*ends, 3)], "query_id string, pick int, text string")
    chat = ChatGenerator(load, parallel=3, attempts=2, pause=0.01)

    def answers(questions):
        return {r.query_id: r for r in answer_from_results(questions, found, chat, replies=replies).collect()}

    got = answers(asked)
    assert {i: r.answer for i, r in got.items()} == {"0": "reply 0", "1": "reply 1", "2": "reply 2", "5": "reply 0", "9": None}
    assert got["9"].status_code == 500 and "TimeoutError: busy" in got["9"].detail
    assert calls() == ["0", "1", "1", "2", "9", "9"]
    # A second run sends what failed and what is new; a question without context sends nothing.
    more = asked.unionByName(spark.createDataFrame([("3", "question 3"), ("4", "question 4")], asked.schema))
    got = answers(more)
    assert got["3"].answer == "reply 3" and got["4"].status_code == 200 and got["0"].answer == "reply 0"
    assert calls() == ["0", "1", "1", "2", "3", "9", "9", "9", "9"]
    with pytest.raises(ValueError):
        ChatGenerator(load, attempts=0)


def test_calls_overlap_up_to_the_bound(spark):
    def load():
        import time
        from threading import Lock

        lock, now = Lock(), [0, 0]

        def ask(system, user, **options):
            with lock:
                now[0] += 1
                now[1] = max(now)
            time.sleep(0.05)
            with lock:
                now[0] -= 1
            return str(now[1])

        return ask

    prompts = spark.range(12).coalesce(1).select(F.concat(F.lit("p"), "id").alias("p"))
    most = [int(r[0]) for r in prompts.select(ChatGenerator(load, parallel=4).generate("s", F.col("p"))["answer"]).collect()]
    assert max(most) == 4
