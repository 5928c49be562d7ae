import json
import random
import re

from pyspark.sql import functions as F

from docengine.operators import chat, evaluation, glossary, prompt

RECORDED = [
    ("r.pdf", "DSO", "Distribution System Operation", 95), ("r.pdf", "dso", "Other", 81),
    ("r.pdf", "CBA", "Cost Benefit Analysis", 100), ("r.pdf", "LAE", "Too uncertain", 79),
    ("r.pdf", "C_A", "With underscore", 90), ("r.pdf", None, "No acronym", 90),
]


def known(spark):
    return spark.createDataFrame(
        RECORDED, "file_name string, acronym string, definition string, certainty int"
    )


def test_lookup_function(spark):
    known(spark).createOrReplaceTempView("known_glossary")
    glossary.create_lookup_function(spark, "known_glossary")
    look = lambda term: [tuple(r) for r in spark.sql(f"SELECT * FROM lookup_glossary('{term}')").collect()]
    assert look("CBA") == [("Cost Benefit Analysis", 100)]
    assert look("LAE") == []
    assert look("DsO ") == [("Distribution System Operation", 95), ("Other", 81)]
    assert [tuple(r) for r in glossary.lookup_term(known(spark), "DsO ").collect()] == look("DsO ")
    lateral = spark.sql("SELECT t.x, f.* FROM VALUES ('cba'), ('zz') t(x) LEFT JOIN LATERAL lookup_glossary(t.x) f")
    assert sorted(map(tuple, lateral.collect()), key=str) == [("cba", "Cost Benefit Analysis", 100), ("zz", None, None)]


def test_batch_lookup_equals_ilike(spark):
    rng = random.Random(5)
    acronyms = ["".join(rng.choices("ABc_%\\é", k=rng.randint(1, 5))) for _ in range(120)]
    terms = ["".join(rng.choices("abC%_é ", k=rng.randint(0, 4))) for _ in range(80)]
    terms += ["%", "_", "__", "%%", "", "\\\\_", "a\\\\%", "%b%", "a%b", " c% ", "\\\\%%", "_\\\\_"]
    terms = [t.replace("\\\\", "\\") for t in terms]
    rows = spark.createDataFrame([(a, f"d{i}", 80 + i % 20) for i, a in enumerate(acronyms)],
                                 "acronym string, definition string, certainty int")
    asked = spark.createDataFrame([(t,) for t in set(terms)], "term string")
    got = glossary.lookup_batch(asked, rows, min_certainty=85)
    expected = asked.join(rows.filter("certainty >= 85"), F.expr("acronym ILIKE trim(term)")).select(
        "term", "definition", "certainty"
    )
    assert sorted(map(tuple, got.drop("rank").collect())) == sorted(map(tuple, expected.collect()))
    by_term = {}
    for row in sorted(expected.collect(), key=lambda r: (-r["certainty"], r["definition"])):
        by_term.setdefault(row["term"], []).append(row["definition"])
    ranked = [(r["term"], r["rank"], r["definition"]) for r in got.collect()]
    assert sorted(ranked) == sorted((t, i + 1, d) for t, ds in by_term.items() for i, d in enumerate(ds))


def test_responses(spark):
    good = {"acronym": "A", "definition": "Alpha", "certainty": 90}
    rows = spark.createDataFrame(
        [("list", json.dumps([good, good])), ("object", json.dumps(good)), ("bad", "no json at all"),
         ("null", None), ("vague", json.dumps([{**good, "certainty": "high"}])), ("empty", "[]")],
        "file_name string, glossary_json string",
    )
    got = [(r["file_name"], r["certainty"]) for r in glossary.flatten_responses(rows).collect()]
    assert sorted(got, key=str) == [("list", 90), ("list", 90), ("object", 90), ("vague", None)]
    assert [r["file_name"] for r in glossary.rejected_responses(rows).collect()] == ["bad"]


def test_requests_use_like_on_the_name(spark):
    rows = spark.createDataFrame([("DSO_x.pdf", "abcdef"), ("DSO-x.pdf", "gh"), ("no", "i")], "file_name string, text string")
    got = glossary.glossary_requests(rows, 4, prompt="<{content}>", name_like="DSO_x.pdf")
    assert sorted((r["file_name"], r["window_num"], r["start"], r["prompt"]) for r in got.collect()) == [
        ("DSO-x.pdf", 0, 1, "<gh>"), ("DSO_x.pdf", 0, 1, "<abcd>"), ("DSO_x.pdf", 1, 5, "<ef>")
    ]


def test_mined_acronyms(spark):
    text = ("The Distribution System Operation (DSO) and the Output Delivery Incentive (ODI), see "
            "(above) or Annual Report (ARX) or x (Q) and nothing at all (ZZ). Revenue Incentives Innovation "
            "Outputs Electricity Distribution (RIIO-ED2), Distribution Network Operators (DNOs), "
            "a b c d e f g h i j k l (ABCDEFGHIJKL), Ökologische Ämter (ÖÄ).")
    rows = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "id int, text string")
    assert [tuple(r) for r in glossary.mine_acronyms(rows).collect()] == [
        (1, "DSO", "Distribution System Operation", 100),
        (1, "ODI", "Output Delivery Incentive", 100),
        (1, "RIIO-ED2", "Revenue Incentives Innovation Outputs Electricity Distribution", 100),
        (1, "DNOs", "Distribution Network Operators", 100),
        (1, "ABCDEFGHIJKL", "a b c d e f g h i j k l", 100),
        (1, "ÖÄ", "Ökologische Ämter", 100),
    ]


def test_prompt(spark):
    passages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "question_id int, rank int, content string")
    assert prompt.context_of(passages).first()["context"] == "Passage: a\nPassage: b\n"
    asked = spark.createDataFrame([("{question}", None, "Why?")], "context string, chat_history string, question string")
    made = prompt.with_prompt(asked, "{chat_history}|{context}|{question}").first()["prompt"]
    assert made == "|{question}|Why?"


def test_patterns_without_letters_meet_every_acronym(spark):
    entries = [(f"A{i}", f"d{i}", 90) for i in range(200)] + [("B", "b", 90), ("", "none", 90)]
    known = spark.createDataFrame(entries, "acronym string, definition string, certainty int")
    asked = spark.createDataFrame([("%",), ("_",), ("a__",), (None,)], "term string")
    found = glossary.lookup_batch(asked, known).groupBy("term").count().collect()
    assert {r["term"]: r["count"] for r in found} == {"%": 202, "_": 1, "a__": 90}


def long_conversation():
    return [(7, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(600)] + [(8, 3, "user", "x")]


def test_history_and_transcript_of_a_long_conversation(spark):
    rows = spark.createDataFrame(long_conversation(), "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = {(r["conv_id"], r["turn"]): r["messages"] for r in chat.chat_history(rows).collect()}
    assert len(got) == 601
    for t in (0, 255, 256, 511, 599):
        assert [m["content"] for m in got[7, t]] == [f"m{i}" for i in range(t + 1)]
    assert [tuple(m) for m in got[8, 3]] == [("user", "x")]
    text = {r["conv_id"]: r["transcript"] for r in chat.transcript(rows, F.col("text")).collect()}
    assert text[7] == "".join(f"m{i}\n\n" for i in range(600))
    record = evaluation.evaluation_records(chat.chat_history(rows)).filter("conv_id = 8").first()
    assert record["request"]["messages"][0]["content"] == "x" and record["expected_response"] is None


def test_rendered_like_indented_json(spark):
    rows = spark.createDataFrame(
        [(1, 0, "text", "hi", None, None),
         (1, 1, "text", "", None, [("c1", "look", {"a": 'q"x'}), ("c2", "look", None)]),
         (1, 2, "tool", "re\nsult", "c1", None)],
        "conv_id int, turn bigint, kind string, text string, call_id string, "
        "tool_calls array<struct<id:string,name:string,arguments:map<string,string>>>",
    )
    call = lambda i, a: "<tool_call>" + json.dumps({"id": i, "name": "look", "arguments": a}, indent=2) + "</tool_call>"
    result = json.dumps({"id": "c1", "content": "re\nsult"}, indent=2)
    expected = ("hi\n\n" + call("c1", '{"a":"q\\"x"}') + call("c2", "{}") + "\n\n"
                + f"<tool_call_result>{result}</tool_call_result>\n\n")
    assert chat.transcript(rows, chat.rendered_message()).first()["transcript"] == expected
    assert chat.finished(rows).first()["finished"] is True
    assert chat.finished(rows.filter("turn < 2")).first()["finished"] is False


def test_system_message(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (2, 0, "user", "v")],
                                 "conv_id bigint, turn bigint, role string, text string")
    got = sorted(tuple(r) for r in chat.prepend_system(rows, "P").collect())
    assert got == [
        (1, -1, "system", "P"), (1, 0, "system", "s"), (1, 1, "user", "u"), (2, -1, "system", "P"), (2, 0, "user", "v")
    ]
    column = F.from_json(F.lit('[{"role":"user","content":"v"}]'), "array<struct<role:string,content:string>>")
    made = spark.range(1).select(chat.prepend_system_message(column, "P").alias("m")).first()["m"]
    assert [tuple(m) for m in made] == [("system", "P"), ("user", "v")]


def test_tool_calls(spark):
    text = ('<uc_function_call>{"id":"1","name":"f","arguments":"{}"}</uc_function_call>'
            '<uc_function_call>{"id":"2","name":"g","arguments":"{}"}</uc_function_call>'
            '<uc_function_result>{"id":"1","content":"r"}</uc_function_result><uc_function_call>broken</uc_function_call>')
    rows = spark.createDataFrame([(1, 5, text), (2, 0, "nothing")], "conv_id int, turn bigint, text string")
    got = sorted((r["call_id"], r["turn"], r["name"], r["result"]) for r in chat.tool_calls(rows).collect())
    assert got == [("1", 5, "f", "r"), ("2", 5, "g", None)]
    assert re.search("uc_function", chat.RECORDED_CALL)
