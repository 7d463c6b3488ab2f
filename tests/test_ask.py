from tessera.plans import ask
from tessera.plans.planners import PLANNERS, ask_all, context_block, council_plan, propose_chart
from tessera.plans.tools import Tools
from tessera.providers import LocalProvider, count_tokens, stream_text
from tessera.sources import stores

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (200).to_bytes(4, "big") + (150).to_bytes(4, "big")

CHUNKS = "chunk_id string, filename string, chunk_index int, content string, source_type string, source_format string, page_number int, embedding array<double>"
TEXTS = ["the budget was approved by the board", "routers were replaced in march", "the supplier sent new prices", "budget of the port", "training for new staff", "the board met in june"]


class Splitting(LocalProvider):
    def complete(self, prompt, max_tokens):
        return "1. who approved the budget\n2. when were routers replaced"


class Failing(LocalProvider):
    def complete(self, prompt, max_tokens):
        raise OSError("down")


def tables(spark):
    p = LocalProvider(64)
    rows = [(f"c{i}", f"d/f{i % 3}.txt", i // 3, t, "text", "txt", 1, p.embed([t])[0]) for i, t in enumerate(TEXTS)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    return chunks, chunks.filter("chunk_index = 0").select("filename", "embedding")


def test_questions_are_split_or_stay_whole(spark):
    q = spark.createDataFrame([(1, "budget and routers"), (2, None)], "query_id long, text string")
    assert [r.text for r in ask.sub_question_set(q, Splitting()).orderBy("ask_no").collect()] == ["budget and routers", "who approved the budget", "when were routers replaced"]
    assert [r.text for r in ask.sub_question_set(q, Failing()).collect()] == ["budget and routers"]


def test_searches_over_parts(spark):
    chunks, summaries = tables(spark)
    q = spark.createDataFrame([(1, "budget and routers")], "query_id long, text string")
    got = ask.decompose_and_retrieve(q, chunks, summaries, Splitting(), 3).orderBy("rank").collect()
    assert got and any("budget" in r.content for r in got) and any("routers" in r.content for r in got)
    asks = ask.sub_question_set(q, Splitting())
    assert ask.council(asks, chunks, summaries, 4).count() > 0
    walked = spark.createDataFrame([(1, 1, "c2")], "query_id long, rank int, chunk_id string")
    assert any("supplier" in r.content for r in ask.council(asks, chunks, summaries, 9, walked).collect())
    web = stores.PagesSearch([{"title": f"t{i}", "url": f"u{i % 3}", "content": "budget routers"} for i in range(5)])
    assert [r.url for r in ask.web_fan_out(asks, web, 2).orderBy("place").collect()] == ["u0", "u1"]
    seen = ask.research([asks, asks], chunks, summaries, 2).collect()
    assert len({r.chunk_id for r in seen}) == len(seen)


def test_named_documents_sections_and_listing(spark):
    chunks, summaries = tables(spark)
    named = spark.createDataFrame([(1, "D/F0.TXT"), (1, "f1.txt"), (1, "nothing"), (1, "")], "query_id long, name string")
    assert sorted((r.name, r.filename) for r in ask.resolve_documents(named, summaries).collect()) == [("D/F0.TXT", "d/f0.txt"), ("f1.txt", "d/f1.txt")]
    assert ask.group_sections(chunks, 10_000).count() == 3 and ask.group_sections(chunks, 5).count() == 6
    assert ask.list_documents_tool(chunks).startswith("3 document(s) total.\nFilenames (showing 3 of 3):\n- d/f0.txt (2 chunks)") and ask.list_documents_tool(chunks, "zzz") == "No documents match that filter."
    graded = spark.createDataFrame([("a", True, 0, 1.0), ("a", False, 2, 3.0)], "mode string, correct boolean, warnings int, seconds double")
    assert tuple(ask.score_answers(graded).first()) == ("a", 2, 1, 1, 2.0)


class Scripted(LocalProvider):
    def __init__(self, reply):
        super().__init__()
        self.reply, self.prompts = reply, []

    def complete(self, prompt, max_tokens):
        self.prompts.append(prompt)
        return self.reply


def test_planners_parse_and_fall_back():
    q = {"question": "Who signed the lease?", "sub_questions": ["a", "b", "c"], "notes": ["n1", "n2"], "facts": [("x", "owns", "y"), ("u", "likes", "v")], "excerpts": ["e1", "e2"], "filename": "f", "section": "s"}
    told = lambda name, reply: PLANNERS[name].ask(Scripted(reply), q)
    assert told("complexity", "Complex.") is True and told("complexity", "<think>COMPLEX</think>SIMPLE") is False
    assert told("decomposition", "1. a\n2) b") == [q["question"], "a", "b"]
    assert told("angles", "How - x\n**Who**: y\nWhen: NONE\nwho: z") == [("who", "y"), ("how", "x")]
    assert told("corpus", "ALL") == [""] and told("corpus", "ALL\nBudget") == ["Budget"] and told("corpus", "NONE") == [] and told("figures", "a\nb\nc") == ["a", "b"]
    assert told("research", "SUB-QUESTIONS:\n1. s\nDOCUMENTS: d.pdf\nWEB:\nNONE") == {"sub_questions": ["s"], "documents": ["d.pdf"], "web_queries": []}
    assert told("read", "[#1] it rained\n- [#9] no\n[#2] The excerpt does not mention it\n[#2] NONE\n3. [#2] 4 sites") == [(1, "it rained"), (2, "4 sites")]
    assert told("note_check", "2, 7") == [2] and told("note_check", "None of them") == []
    assert told("gaps", "VERDICTS:\n1: ANSWERED\nQ2 - MISSING, nothing\n3. PARTIAL\nQUERIES:\n- new one\n- B") == {"missing": ["b"], "queries": ["new one"]}
    assert told("gaps", "VERDICTS:\n1: ANSWERED\nQUERIES:\nx")["queries"] == [] and told("gaps", "?") == {"missing": [], "queries": []}
    assert told("fact_filter", '```json\n{"fact": [["u", "like", "v"], ["bad"]]}\n```') == [1] and told("triples", '[["a", "b", "c"], ["a"]]') == [["a", "b", "c"]] and told("entities", '{"named_entities": ["A", "A"]}') == ["A"]
    assert told("title", '"Lease of the port"') == "Lease of the port" and told("title", "x" * 90) == q["question"] and told("claim", "NO") is False and told("summary", " ") is None
    failed = {n: p.ask(Failing(), q) for n, p in PLANNERS.items()}
    assert failed["complexity"] is False and failed["note_check"] == [1, 2] and failed["gaps"] == {"missing": [], "queries": []} and failed["fact_filter"] == [] and failed["claim"] is True and failed["title"] == q["question"]
    shown = context_block("now", [{"role": "user", "content": "x" * 600}] * 6)
    assert shown.count("user:") == 4 and "x" * 501 not in shown and shown.endswith("Question now: now")


def test_council_plan_and_charts():
    assert council_plan(Scripted("x"), "Hello!") == {"content": [], "figures": [], "corpus": [], "web": []}
    plan = council_plan(Scripted("Who: y"), "q", web=True)
    assert plan["content"] == ["q", "y"] and plan["figures"] == [] and plan["corpus"] == ["Who: y"] and plan["web"] == ["Who: y"]
    assert propose_chart(Scripted("```chart\n{}\n```"), "q", "a", ["s"]) == "```chart\n{}\n```" and propose_chart(Scripted("NONE"), "q", "a", ["s"]) is None and propose_chart(Failing(), "q", "a", ["s"]) is None


def test_summaries_are_merged_until_one_is_left(spark):
    chunks, _ = tables(spark)
    got = {r.filename: r.summary for r in ask.summarise_documents(chunks, Scripted("short"), 12).collect()}
    assert got == {f"d/f{i}.txt": "short" for i in range(3)} and ask.summarise_documents(chunks, Failing()).count() == 0
    requests = spark.createDataFrame([(1, '{"question": "a lease?"}'), (2, None)], "query_id long, request string")
    assert [r.plan for r in ask_all(requests, "title", Scripted("Lease")).orderBy("query_id").collect()] == ['"Lease"', '"Lease"']


def test_tools_of_a_turn(spark, tmp_path):
    chunks, summaries = tables(spark)
    store = stores.ObjectStore(spark, f"file://{tmp_path}")
    store.put("i.png", PNG)
    web = stores.PagesSearch([{"title": "Ports", "url": "u", "content": "the port budget"}])
    t = Tools(chunks, summaries, Splitting(), store, web, limit=3)
    assert t.forced(0) == "web_search" and t.forced(1) is None and Tools(chunks, summaries, Splitting()).forced(0) is None and "web_search" not in Tools(chunks, summaries, Splitting()).offered()
    calls = [{"name": "web_search", "arguments": {"query": "budget"}}]
    assert t.with_companions(calls, "web_search")[1] == {"name": "retrieve", "arguments": {"query": "budget"}} and t.with_companions(calls, None) == calls
    assert t.call("web_search", '{"query": "port budget"}') == "[1] Ports\nu\nthe port budget" and t.call("web_search", {"query": "port"}) == "[1] (same passage as [1] above)"
    found = t.call("retrieve", {"query": "budget and routers"})
    assert found.startswith("[2] ") and len(t.sources) == found.count("[") + 1 and t.call("retrieve", "{bad").startswith("Error")
    assert t.call("describe_image", {"image_path": "i.png"}).startswith("image of") and t.call("describe_image", {"image_path": "none.png"}).startswith("Error: no image") and t.call("nothing", {}).startswith("Error: unknown")
    assert t.call("list_documents", None).startswith("3 document(s)") and Tools(chunks, summaries, Splitting(), web=web, room=5).call("web_search", {"query": "port"}).startswith("(1 more")
    assert "".join(stream_text(Scripted("a b  c"), "p", 9)) == "a b  c" and count_tokens(Failing(), "abc") == 3
