import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import audio, crypto, text
from skein.functions.chunking import BYTES, chunks
from skein.plans import engine, graph, providers
from skein.plans.graph import GraphError
from tests.conftest import rows


def flow(nodes, edges):
    return json.dumps({"nodes": nodes, "edges": [{"source": a, "target": b} for a, b in edges]})


def linear(*names):
    return flow([{"id": x, "type": "input"} for x in names], list(zip(names, names[1:])))


def order(nodes, edges, tie="list"):
    return [x.id for x in graph.topological(graph.parse(flow([{"id": x, "type": "input"} for x in nodes], edges)), tie)]


# ---------------------------------------------------------------- graphs


def test_topological_order():
    assert order("abcd", [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]) == ["a", "b", "c", "d"]
    assert order("dcba", [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]) == ["a", "c", "b", "d"]
    assert order("ab", [("a", "b"), ("a", "b")]) == ["a", "b"]
    assert order("ba", []) == ["b", "a"] and order("ba", [], "java_hash") == ["a", "b"]
    for edges in ([("a", "b"), ("b", "a")], [("a", "a")]):
        with pytest.raises(GraphError, match="cycle"):
            order("ab", edges)
    with pytest.raises(GraphError, match="unknown"):
        order("a", [("a", "z")])


def test_entry_exit_and_engines():
    g = graph.parse(flow([{"id": x, "type": "input"} for x in ("r1", "r2", "e")], [("r1", "e")]))
    assert graph.entry(g).id == "r1" and graph.exit_node(g).id == "r2"
    assert [x.id for x in graph.reachable(g)] == ["r1", "e"]
    assert [graph.select_engine(x) for x in (None, " ", "LangGraph ", "other")] == ["dag", "dag", "langgraph", "dag"]
    assert graph.without_node(g, "r1").edges == ()


def test_lint():
    nodes = [{"id": "l", "type": "llm", "data": {"prompt": "{{a}} {{b}}", "inputParams": [{"name": "a", "type": "reference", "referenceNode": "x.y"}, {"name": "c", "type": "input"}], "outputParams": [{"name": "o"}]}}, {"id": "t", "type": "tts"}]
    assert len(graph.lint(graph.parse(flow(nodes, [("l", "t")])))) == 4


# ---------------------------------------------------------------- runs

LLM = {"provider": "openai", "apiUrl": "u", "apiKey": "k", "model": "m"}


def run(spark, document, inputs=("q",), kind="dag", **more):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "run_id long, input string")
    return engine.run_workflow(frame, document, kind, **more)


def output(frame):
    return [json.loads(x.output) if x.output else None for x in frame.orderBy("run_id").collect()]


def answer(template, params=()):
    return flow([{"id": "input-1", "type": "input"}, {"id": "output-1", "type": "output", "data": {"responseContent": template, "outputParams": list(params)}}], [("input-1", "output-1")])


def test_answers(spark):
    assert output(run(spark, answer("{{output}}"), ["Hello"])) == [{"output": ""}]
    assert output(run(spark, answer("处理完成"), ["x"])) == [{"output": "处理完成"}]
    assert output(run(spark, answer(""), ["x", None])) == [{"output": "x"}, {"output": None}]
    both = answer("{{a}}-{{b}}", [{"name": "a", "type": "reference", "referenceNode": "input-1.user_input"}, {"name": "b", "type": "input", "value": "v"}])
    assert output(run(spark, both, ["x", ""])) == [{"output": "x-v"}, {"output": "-v"}]
    assert run(spark, both, []).count() == 0


def test_engines_differ_in_references(spark):
    nodes = [{"id": "input-1", "type": "input"}, {"id": "llm-1", "type": "llm", "data": {**LLM, "prompt": "{{q}}", "inputParams": [{"name": "q", "type": "reference", "referenceNode": "input-1.input"}]}}, {"id": "tts-1", "type": "tts", "data": {"apiKey": "k"}}, {"id": "output-1", "type": "output", "data": {"responseContent": "{{a}}", "outputParams": [{"name": "a", "type": "reference", "referenceNode": "llm-1.output"}]}}]
    document = flow(nodes, [("input-1", "llm-1"), ("llm-1", "tts-1"), ("tts-1", "output-1")])
    assert output(run(spark, document, ["hey"], "langgraph")) == [{"output": "hey"}]
    assert output(run(spark, document, ["hey"]))[0]["output"].startswith("/audio/")


def test_failures(spark):
    nodes = [{"id": "i", "type": "input"}, {"id": "l", "type": "llm", "data": {"provider": "openai"}}, {"id": "o", "type": "output", "data": {"responseContent": "late"}}]
    document = flow(nodes, [("i", "l"), ("l", "o")])
    dag = run(spark, document).first()
    assert (dag.status, dag.output, [x.status for x in dag.node_results]) == ("FAILED", None, ["SUCCESS", "FAILED"])
    other = run(spark, document, kind="langgraph").first()
    assert (other.status, json.loads(other.output), [x.nodeId for x in other.node_results]) == ("FAILED", {"output": "late"}, ["i", "o"])
    with pytest.raises(GraphError):
        run(spark, "no json")
    assert run(spark, "no json", kind="langgraph").first().status == "FAILED"
    with pytest.raises(GraphError, match="unknown type"):
        run(spark, flow([{"id": "x", "type": "odd"}], []))


def test_a_failing_provider_fails_the_run_and_not_the_job(spark):
    def broken(model, temperature, system, prompts):
        raise RuntimeError("no service")

    old = engine.providers.completer
    engine.providers.completer = lambda name: broken
    try:
        row = run(spark, flow([{"id": "l", "type": "llm", "data": {**LLM, "prompt": "p"}}], [])).first()
    finally:
        engine.providers.completer = old
    assert (row.status, row.error) == ("FAILED", "no service")


def test_custom_outputs_tokens_and_config(spark):
    data = {"configId": "3", "prompt": "one two", "outputParams": [{"name": "a"}, {"name": "b"}]}
    configs = {3: {"provider": " QWEN ", "api_url": "u", "api_key": "k", "model": "m", "temperature": None}}
    out = output(run(spark, flow([{"id": "l", "type": "llm", "data": data}], []), configs=configs))[0]
    assert out == {"a": "one two", "b": "one two", "inputTokens": "2", "outputTokens": "2", "totalTokens": "4", "tokens": "4"}
    assert engine.resolve_config({"configId": 9, "provider": "p"}, "llm", configs)["temperature"] == 0.7
    with pytest.raises(GraphError):
        engine.resolve_config({"configId": "x"}, "llm", configs)


def test_providers_and_settings_in_one_rule():
    named = {"apiUrl": "u", "apiKey": "k", "model": "m"}
    assert engine.resolve_config({**named, "provider": " StepFun "}, "llm", {})["provider"] == "step"
    assert engine.resolve_config({**named, "provider": ""}, "智谱", {})["provider"] == "zhipu"
    assert engine.resolve_config(named, "llm", {})["provider"] is None
    assert engine.resolve_config({"configId": 1, "provider": "通义千问"}, "llm", {1: {"provider": " ", "model": "x"}})["provider"] == "qwen"
    assert engine.resolve_config({"modelName": "x"}, "step", {})["model"] is None
    assert providers.completer("nobody") is None and providers.completer("openai") is providers.echo


def test_speech_end_to_end(spark, tmp_path):
    nodes = [{"id": "i", "type": "input"}, {"id": "t", "type": "tts", "data": {"apiKey": "k", "voice": "serena"}}]
    said = ["word " * 500, "", None, "short", "word " * 500]
    made = run(spark, flow(nodes, [("i", "t")]), said, audio_folder=str(tmp_path / "audio")).orderBy("run_id").collect()
    assert [x.status for x in made] == ["SUCCESS", "FAILED", "FAILED", "SUCCESS", "SUCCESS"] and made[1].error == "there is no text to speak"
    urls = [json.loads(x.output)["audioUrl"] for x in made if x.output]
    assert urls[0] == urls[2] and sorted(x.name for x in (tmp_path / "audio").iterdir()) == sorted({x.removeprefix("/audio/") for x in urls})
    body = (tmp_path / "audio" / urls[0].removeprefix("/audio/")).read_bytes()
    assert body[44:] == ("word " * 500).encode() and struct.unpack_from("<I", body, 4)[0] == len(body) - 8
    result = made[0].node_results[1]
    assert int(json.loads(made[0].output)["chunks"]) == len(result.progress) == len(chunks("word " * 500)) and result.progress[0] == ("word " * 10) + "..."
    none = run(spark, flow([nodes[0], {"id": "t", "type": "tts"}], [("i", "t")]), ["x"]).first()
    assert none.error == "speech needs an apiKey"


def test_a_failing_voice_fails_the_run_and_not_the_job(spark, tmp_path):
    def speak(chunk, voice):
        if "bad" in chunk:
            raise RuntimeError("no voice")
        return providers.tone(chunk, voice)

    nodes = [{"id": "i", "type": "input"}, {"id": "t", "type": "tts", "data": {"apiKey": "k"}}, {"id": "o", "type": "output"}]
    document = flow(nodes, [("i", "t"), ("t", "o")])
    made = run(spark, document, ["good", "bad"], speak=speak, audio_folder=str(tmp_path)).orderBy("run_id").collect()
    assert [(x.status, x.error) for x in made] == [("SUCCESS", None), ("FAILED", "no voice")]
    other = run(spark, document, ["bad"], "langgraph", speak=speak, audio_folder=str(tmp_path)).first()
    assert (other.status, json.loads(other.output), [x.nodeId for x in other.node_results]) == ("FAILED", {"output": "bad"}, ["i", "o"])


def test_calls_before_speech_are_made_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def counted(model, temperature, system, prompts):
        import uuid

        for one in prompts:
            (log / uuid.uuid4().hex).write_text(one)
        return providers.echo(model, temperature, system, prompts)

    nodes = [{"id": "i", "type": "input"}, {"id": "l", "type": "llm", "data": {**LLM, "prompt": "say it"}}, {"id": "t", "type": "tts", "data": {"apiKey": "k"}}]
    old = engine.providers.completer
    engine.providers.completer = lambda name: counted
    try:
        assert run(spark, flow(nodes, [("i", "l"), ("l", "t")]), ["a", "b", "c"], audio_folder=str(tmp_path / "o")).where("status = 'SUCCESS'").count() == 3
    finally:
        engine.providers.completer = old
    assert len(list(log.iterdir())) == 3


def test_events_of_speech_and_streams(spark, tmp_path):
    nodes = [{"id": "i", "type": "input"}, {"id": "l", "type": "llm", "data": {**LLM, "prompt": "one two", "streaming": True}}, {"id": "t", "type": "tts", "data": {"apiKey": "k"}}]
    document = flow(nodes, [("i", "l"), ("l", "t")])
    told = [(x.node_id, x.event_type.rpartition("_")[2], x.data and json.loads(x.data)) for x in engine.run_events(run(spark, document, listen=True, audio_folder=str(tmp_path))).orderBy("seq").collect()]
    assert [(x, y) for x, y, _ in told] == [(None, "START"), ("i", "START"), ("i", "SUCCESS"), ("l", "START"), ("l", "PROGRESS"), ("l", "PROGRESS"), ("l", "SUCCESS"), ("t", "START"), *[("t", "PROGRESS")] * 4, ("t", "SUCCESS"), (None, "COMPLETE")]
    assert told[4][2] == {"chunk": "one", "accumulated": "one"} and told[5][2] == {"chunk": " two", "accumulated": "one two"} and told[6][2]["output"]["tokens"] == "0"
    assert [x[2] for x in told[8:12]] == [{"totalChunks": 1, "currentChunk": 0}, {"totalChunks": 1, "currentChunk": 1, "chunkText": "one two..."}, {"totalChunks": 1, "currentChunk": 1, "completedChunks": 1}, None]
    assert told[-2][2]["duration"] >= 0 and set(told[-2][2]) == {"input", "output", "duration"}
    quiet = engine.run_events(run(spark, document, audio_folder=str(tmp_path))).where("node_id = 'l'")
    assert quiet.count() == 2


def test_records_of_runs(spark):
    row = engine.execution_records(run(spark, answer("x"), ['say "hi"', None]), 5).orderBy("run_id").collect()
    assert json.loads(row[0].input_data) == {"input": 'say "hi"'} and json.loads(row[1].input_data) == {"input": None}
    assert row[0].duration == 0 and [set(x) for x in json.loads(row[0].node_results)] == [{"nodeId", "nodeName", "status", "input", "output", "duration"}] * 2


def test_events_of_a_run(spark):
    events = engine.run_events(run(spark, answer("x"))).orderBy("seq").collect()
    assert [x.event_type for x in events] == ["WORKFLOW_START", "NODE_START", "NODE_SUCCESS", "NODE_START", "NODE_SUCCESS", "WORKFLOW_COMPLETE"]


# ---------------------------------------------------------------- kernels


def one(spark, *columns):
    return spark.range(1).select(*(x.alias(f"c{i}") for i, x in enumerate(columns))).first()


def test_templates(spark):
    def render(template, **params):
        pairs = [F.lit(x) for pair in params.items() for x in pair]
        return text.render(F.lit(template).cast("string"), F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))

    got = one(spark, render("hi {{name}} {{ name }} {{zz}}!", name="Bob"), render("{{a}} {{b}}", a="{{b}}", b="x"), render("{{b}} {{a}}", a="{{b}}", b="x"), render(None), render("none"), render("{{a\n}}", a="x"))
    assert tuple(got) == ("hi Bob {{ name }} !", "x x", "x {{b}}", "", "none", "{{a\n}}")


def test_names_and_addresses(spark):
    got = one(spark, text.base_url(F.lit(" https://h/v1/chat/completions/ ")), text.base_url(F.lit("https://h/api/V1//")), text.base_url(F.lit("https://h/v1/v1/chat/completions")), text.provider(F.lit(" StepFun ")), text.provider(F.lit("MyCorp"), "storage"), text.provider(F.lit(None).cast("string"), "client"), text.clock(F.lit(125.9)), text.spent_ms(F.lit("总耗时 42ms")), text.role(F.lit(" admin ")))
    assert tuple(got) == ("https://h", "https://h/api", "https://h", "step", "MyCorp", "", "02:05", 42, "ADMIN")


def test_tool_arguments_voices_and_requests(spark):
    from skein.sources.skills import tool_arguments

    frame = spark.createDataFrame([('{"skill_name": "a", "reference_name": "b"}',), (" a : b ",), ("a",), ("  ",), (None,)], "t string")
    assert [x[0] and tuple(x[0]) for x in frame.select(tool_arguments(F.col("t"))).collect()] == [("a", "b"), ("a", "b"), ("a", None), None, None]
    got = one(spark, text.voice(F.lit("serena")), text.voice(F.lit("x")), text.voice(F.lit(None).cast("string")), text.palette(F.lit(" llm")), text.palette(F.lit("IO")), text.missing_fields(a=F.lit(" \u3000"), b=F.lit("x"), c=F.lit(None).cast("string")))
    assert tuple(got) == ("SERENA", "CHERRY", "CHERRY", "LLM", None, ["a", "c"])


def test_crypto(spark):
    hidden = crypto.encrypt(F.lit("钥匙"), "s")
    got = one(spark, hidden, crypto.decrypt(hidden, "s"), crypto.encrypt(F.lit("enc:v1:x"), "s"), crypto.encrypt(F.lit("  "), "s"), crypto.encrypt(F.lit(None).cast("string"), "s"), crypto.decrypt(F.lit("plain"), "s"))
    assert got.c0.startswith("enc:v1:") and tuple(got)[1:] == ("钥匙", "enc:v1:x", "  ", None, "plain")
    frame = spark.createDataFrame([('{"a":[{"apiKey":"k","n":"中"}],"apiKey":3}',), ("apiKey {",), (None,)], "j string")
    assert [x[0] for x in frame.select(crypto.replace_in_json(F.col("j"))).collect()] == ['{"a":[{"apiKey":"***","n":"中"}],"apiKey":3}', "apiKey {", None]


def test_crypto_in_json(spark):
    from skein.operators.metadata import encrypted_keys

    body = '{"nodes":[{"data":{"apiKey":"k1","n":"中"}},{"data":{"apiKey":""}}],"apiKey":"k2"}'
    frame = spark.createDataFrame([(body,), ("apiKey {",), (None,), ("{}",)], "j string")
    hidden = encrypted_keys(frame, "s", "j", json=True)
    once = [x[0] for x in hidden.collect()]
    keys = json.loads(once[0])
    assert keys["nodes"][0]["data"]["apiKey"].startswith("enc:v1:") and keys["apiKey"].startswith("enc:v1:") and keys["nodes"][1]["data"]["apiKey"] == ""
    assert once[1:] == ["apiKey {", None, "{}"]
    twice = encrypted_keys(hidden, "s", "j", json=True)
    assert [x[0] for x in twice.select(crypto.decrypt_in_json(F.col("j"), "s")).collect()] == [body, "apiKey {", None, "{}"]


def test_wav(spark):
    parts = [providers.tone("a" * 10, "X"), providers.tone("b" * 6, "X")]
    frame = spark.createDataFrame([(parts,), (parts[:1],), ([b"short"],), ([],)], "p array<binary>")
    merged, single, short, none = (x[0] for x in frame.select(audio.merge(F.col("p"))).collect())
    assert len(merged) == 60 and struct.unpack_from("<I", merged, 4)[0] == 52 and struct.unpack_from("<I", merged, 40)[0] == 16
    assert single == bytearray(parts[0]) and short is None and none is None
    assert [x[0] for x in frame.select(audio.problem(F.col("p"))).collect()] == [None, None, "shorter than a WAV header", "no audio pieces"]


def test_merged_outside_of_expressions():
    pieces = [providers.tone(x, "") for x in ("ab", "", "cde")]
    assert audio.merged(pieces)[44:] == b"abcde" and audio.merged(pieces[:1])[44:] == b"ab"
    for bad in ([], [b"short"], [pieces[0], None]):
        with pytest.raises(ValueError):
            audio.merged(bad)


def test_chunk_vectors():
    sizes = lambda x: [len(y) for y in chunks(x)]
    assert sizes("a" * 1000) == [400, 400, 200] and sizes("a" * 1500) == [400, 600, 400, 100] and sizes("中" * 1000) == [200] * 5
    assert sizes("abcdefghi." * 200) == [400, 600, 400, 400, 200] and sizes("中文字，好。" * 150) == [198, 200, 196, 200, 106]
    assert chunks(None) == chunks("") == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab。，.! 中𝒳é\n", max_size=3000))
def test_chunks_hold_the_text(body):
    found = chunks(body)
    assert "".join(found) == body and all(found) and all(len(x.encode()) <= BYTES for x in found)


# ---------------------------------------------------------------- tables


def test_skills(spark, tmp_path):
    from skein.sources import skills

    for name, body in (("one", "---\nname: 'One'\n# note\ndescription: a: b\nname: Uno\n---\n\nBody\n"), ("two", "no front matter"), ("three", "---\nx: y\n---\n")):
        (tmp_path / name / "reference").mkdir(parents=True)
        (tmp_path / name / "SKILL.md").write_text(body)
    (tmp_path / "one" / "reference" / "b.md").write_text("B")
    (tmp_path / "one" / "reference" / "a.md").write_text("A")
    found = skills.read_skills(spark, str(tmp_path / "none"), str(tmp_path))
    assert rows(found.select("name", "description", "content", "problem")) == [("Uno", "a: b", "Body", None), (None, None, None, "no front matter"), (None, None, None, "no name")]
    references = skills.read_references(spark, str(tmp_path)).withColumn("skill", F.lit("Uno"))
    prompt = skills.prompts(found, references).first().prompt
    assert prompt.index("### a\n\nA") < prompt.index("### b\n\nB") and prompt.startswith("# 技能: Uno\n\na: b\n\n---\n\n## 技能指南\n\nBody\n\n")
    assert skills.reference(references, "Uno", "../a").count() == 0 and skills.reference(references, "Uno", "a").count() == 1


def test_sinks(spark, tmp_path):
    from skein.sources import sinks

    path = str(tmp_path / "t")
    sinks.append(spark.range(3), path)
    sinks.append(spark.range(3, 5), path)
    sinks.swap(spark.read.parquet(path).where("id > 2"), path)
    assert rows(spark.read.parquet(path)) == [(3,), (4,)]
    (tmp_path / "no").write_text("in the way")
    with pytest.raises(Exception):
        sinks.swap(spark.range(2), str(tmp_path / "no" / "table"))
    texts = spark.createDataFrame([("a/b.md", "x"), ("c.md", None), (None, "y"), ("a/b.md", "x")], "name string, content string")
    assert sinks.store_texts(texts, str(tmp_path / "texts")) == 3 and (tmp_path / "texts" / "a" / "b.md").read_text() == "x" and (tmp_path / "texts" / "c.md").read_text() == ""
    assert sorted(x.name for x in (tmp_path / "texts").rglob("*.md*")) == ["b.md", "c.md"] and sinks.store_texts(texts.limit(0), str(tmp_path / "texts")) == 0
    stored = sinks.store_objects(spark.createDataFrame([(1, b"x"), (2, b"x"), (3, None)], "key long, content binary"), str(tmp_path / "o"))
    urls = {x.key: x.url for x in stored.collect()}
    assert urls[1] == urls[2] and urls[3] is None and len(list((tmp_path / "o").iterdir())) == 1


def test_config_changes(spark):
    from skein.operators import metadata

    shape = "id long, provider string, config_name string, api_url string, api_key string, model string, is_default int, updated_at timestamp, deleted int"

    def made(*data):
        return spark.createDataFrame([(i, p, n, "u", k, "m", d, None, x) for i, p, n, k, d, x in data], shape)

    old = made((1, "a", "n1", "k", 1, 0), (2, "a", "n2", "k", 0, 0), (3, "b", "gone", "k", 0, 1))
    new = metadata.upserted(old, made((2, " a ", "n2", None, 1, 0), (9, "b", "gone", "k9", None, 0), (10, "b", "other", "k", 1, 0)), "s")
    got = {x.id: x for x in new.collect()}
    assert {i: x.is_default for i, x in got.items()} == {1: 0, 2: 1, 9: 1, 10: 1}
    assert got[2].api_key.startswith("enc:v1:")
    assert rows(metadata.problems(old, made((4, "a", "n1", "k", 0, 0), (5, None, "x", "k", 0, 0)))) == [(4, "the name is taken"), (5, "missing: provider")]
    assert {x.id: x.is_default for x in metadata.without_config(old, 1).collect()} == {2: 1, 3: 0}
    assert {x.id: x.is_default for x in metadata.with_default(old, 2).collect()} == {1: 0, 2: 1, 3: 0}


def test_sets_and_seeds(spark):
    from skein.operators import metadata

    a = spark.createDataFrame([(0, "x", "1"), (1, "y", "2")], "position int, key string, value string")
    b = spark.createDataFrame([(0, "z", "3"), (1, "x", "4")], "position int, key string, value string")
    assert [tuple(x) for x in metadata.merged_options(a, b, "key", "value").collect()] == [("x", "4"), ("y", "2"), ("z", "3")]
    assert rows(metadata.seeded(a, b, ["key"]).select("key")) == [("x",), ("y",), ("z",)]
    assert rows(metadata.replaced_partition(a, b, "key", "x").select("key", "value")) == [("x", "4"), ("y", "2")]
