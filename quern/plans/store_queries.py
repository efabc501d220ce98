"""Queries of the store, conversations, metrics, logs, roles, prompts, models, agents, JSON and streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quern.config import BM25Config, IndexConfig, MemoryConfig
from quern.functions import json as J
from quern.functions import prompts as P
from quern.functions import security as X
from quern.functions.text import token_count
from quern.operators import access as A
from quern.operators import chains as C
from quern.operators import index as I
from quern.operators import memory as M
from quern.operators import metrics as N
from quern.operators import store as D
from quern.operators.store import Condition, Query
from quern.plans import sqltext as S
from quern.plans.catalog import query
from quern.sources.collections import Collections, load_prompt
from quern.sources.tables import new_folder, table
from quern.streaming import ingest as G

# The store


def _store(name: str, tbl: str, q: Query, id: str, where: str, columns: str, paged: str = "") -> None:
    @query(name, f"SELECT {columns} FROM {tbl} WHERE {where} {paged}")
    def run(spark, sf_dir):
        return D.query(table(spark, sf_dir, tbl), q, id).select(*columns.split(", "))


_store("store_equals", "orders", Query((Condition("o_orderstatus", "equals", "F"),)), "o_orderkey", "o_orderstatus = 'F'", "o_orderkey, o_custkey", "ORDER BY o_orderkey LIMIT 100")
_store("store_contains", "part", Query((Condition("p_type", "contains", "ECON"),)), "p_partkey", "contains(p_type, 'ECON')", "p_partkey, p_type", "ORDER BY p_partkey LIMIT 100")
_store("store_starts_with", "part", Query((Condition("p_brand", "starts_with", "Brand#1"),), "p_name", False), "p_partkey", "starts_with(p_brand, 'Brand#1')", "p_partkey, p_name", "ORDER BY p_name DESC, p_partkey LIMIT 100")
_store("store_less_than", "part", Query((Condition("p_size", "less_than", 5),), limit=None), "p_partkey", "p_size < 5", "p_partkey, p_size")
_store("store_greater_than", "part", Query((Condition("p_size", "greater_than", 45),), limit=None), "p_partkey", "p_size > 45", "p_partkey, p_size")
_store("store_conjunction", "orders", Query((Condition("o_orderstatus", "equals", "O"), Condition("o_orderpriority", "starts_with", "1"), Condition("o_custkey", "less_than", 200)), "o_custkey", True, 25, 10), "o_orderkey", "o_orderstatus = 'O' AND starts_with(o_orderpriority, '1') AND o_custkey < 200", "o_orderkey, o_custkey", "ORDER BY o_custkey, o_orderkey LIMIT 25 OFFSET 10")
_store("store_missing_field", "orders", Query((Condition("no_such_field", "equals", 1),)), "o_orderkey", "false", "o_orderkey")
_store("store_past_end", "nation", Query(offset=1000), "n_nationkey", "true", "n_nationkey", "ORDER BY n_nationkey LIMIT 100 OFFSET 1000")
_store("store_further_operators", "part", Query((Condition("p_size", "not_equals", 10), Condition("p_size", "less_than_or_equal", 20), Condition("p_size", "greater_than_or_equal", 8), Condition("p_type", "ends_with", "O"), Condition("p_size", "in", (9, 11, 20))), limit=None), "p_partkey", "p_size <> 10 AND p_size <= 20 AND p_size >= 8 AND ends_with(p_type, 'O') AND p_size IN (9, 11, 20)", "p_partkey, p_size")


@query("store_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_custkey > 500")
def store_count(spark, sf_dir):
    return D.count(table(spark, sf_dir, "orders"), (Condition("o_orderstatus", "equals", "F"), Condition("o_custkey", "greater_than", 500)))


@query("store_get", "SELECT doc_id, lang FROM documents WHERE doc_id = 7")
def store_get(spark, sf_dir):
    return D.get(table(spark, sf_dir, "documents"), 7, "doc_id").select("doc_id", "lang")


@query("store_full_scan", "SELECT doc_id, n_chars FROM documents")
def store_full_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars")


@query("store_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1, 'NEW'")
def store_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = spark.createDataFrame([(-1, "NEW")], "c_custkey long, c_mktsegment string")
    changes = c.filter("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("CHANGED")).union(new)
    return D.upsert(c, changes, "c_custkey")


@query("store_delete", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)")
def store_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return D.delete(table(spark, sf_dir, "customer"), gone, "c_custkey").select("c_custkey")


@query("store_metadata", "SELECT doc_id::VARCHAR AS id, lang FROM documents WHERE lang = 'de' AND source = 'src3'")
def store_metadata(spark, sf_dir):
    docs = D.to_documents(D.to_records(table(spark, sf_dir, "documents")))
    return D.by_metadata(docs, {"lang": "de", "source": "src3"}).select("id", F.element_at("metadata", "lang").alias("lang"))


@query("store_embedding_cache", "SELECT d.doc_id, coalesce(len(e.embedding), 0)::INT AS size FROM documents d LEFT JOIN (SELECT DISTINCT text, embedding FROM documents x JOIN embeddings y ON x.doc_id = y.vec_id WHERE x.doc_id < 50 AND x.doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)) e USING (text)")
def store_embedding_cache(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("vec_id")).filter("vec_id < 50")
    cache = first.join(table(spark, sf_dir, "embeddings"), "vec_id").select("text", "embedding")
    return D.cached_embeddings(docs, cache).select("doc_id", F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0)).alias("size"))


@query("store_field_text", "SELECT event_id, '\"' || event_type || '\"' AS kind, printf('%.6f', value) AS value, '\"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '\"' AS ts, CASE WHEN value > 50 THEN '1' ELSE '0' END AS high FROM events")
def store_field_text(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "events").select("event_id", D.field_text("string", c("event_type")).alias("kind"), D.field_text("double", c("value")).alias("value"), D.field_text("timestamp", c("ts")).alias("ts"), D.field_text("boolean", c("value") > 50).alias("high"))


@query("store_collections", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def store_collections(spark, sf_dir):
    """Saves, backs up and reads a collection again, in the shared folder."""
    base = new_folder(spark, "collections")
    s = Collections(spark, f"{base}/live")
    s.create("nation")
    s.save("nation", table(spark, sf_dir, "nation"))
    s.backup(f"{base}/copy")
    schema = "n_nationkey int, n_name string, n_regionkey int"
    return Collections(spark, f"{base}/copy").load("nation", schema)


# Conversations

_LAST = MemoryConfig(max_messages=4, max_tokens=120)


@query("memory_last", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def memory_last(spark, sf_dir):
    return M.last_messages(table(spark, sf_dir, "conversations"), _LAST).select("conv_id", "turn")


@query("memory_token_buffer", "SELECT conv_id, turn FROM conversations QUALIFY sum((strlen(text) + 3) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 120")
def memory_token_buffer(spark, sf_dir):
    return M.token_buffer(table(spark, sf_dir, "conversations"), _LAST).select("conv_id", "turn")


_NOW = "2024-01-15 00:00:00"


@query("memory_age", f"SELECT event_id FROM events QUALIFY max(CASE WHEN epoch(TIMESTAMP '{_NOW}') - floor(epoch(ts)) <= 3600 * 200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1")
def memory_age(spark, sf_dir):
    c = replace(MemoryConfig(), max_age_seconds=3600 * 200)
    return M.drop_aged(table(spark, sf_dir, "events"), c, _NOW).select("event_id")


_NAME = "CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'AI' WHEN 'system' THEN 'System' ELSE 'Human' END"
_LINE = f"'[' || {_NAME} || ']: ' || text || E'\\n'"


@query("memory_context", f"SELECT conv_id, string_agg({_LINE}, '' ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def memory_context(spark, sf_dir):
    return M.context(table(spark, sf_dir, "conversations"))


@query("memory_summary", "SELECT conv_id, count(*) AS n_messages, count(*) % 10 AS n_recent, CASE WHEN count(*) >= 10 THEN 'Conversation summary with 10 messages.' ELSE '' END AS summary FROM conversations GROUP BY conv_id")
def memory_summary(spark, sf_dir):
    return M.summaries(table(spark, sf_dir, "conversations"))


_SUM = MemoryConfig(summary_every=4)


@query(
    "memory_summary_context",
    f"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
SELECT conv_id, CASE WHEN max(n) >= 4 THEN E'Previous conversation summary:\\nConversation summary with 4 messages.\\n\\n' ELSE '' END || coalesce(E'Recent messages:\\n' || string_agg(CASE WHEN r <= n % 4 THEN {_LINE} END, '' ORDER BY turn), '') AS context FROM n GROUP BY conv_id""",
)
def memory_summary_context(spark, sf_dir):
    return M.summary_context(table(spark, sf_dir, "conversations"), _SUM)


@query("memory_stats", "SELECT conv_id, count(*) AS message_count, sum((strlen(text) + 3) // 4)::BIGINT AS total_tokens, sum(strlen(text))::BIGINT AS total_bytes FROM conversations GROUP BY conv_id")
def memory_stats(spark, sf_dir):
    return M.stats(table(spark, sf_dir, "conversations"))


@query("chat_tokens", "SELECT conv_id, sum((strlen(text) + 3) // 4 + 4)::BIGINT AS chat_tokens FROM conversations GROUP BY conv_id")
def chat_tokens(spark, sf_dir):
    return M.chat_tokens(table(spark, sf_dir, "conversations"))


# Metrics


@query("metric_counters", "SELECT event_type AS name, count(*) AS value FROM events GROUP BY 1")
def metric_counters(spark, sf_dir):
    return N.counters(table(spark, sf_dir, "events"), "event_type")


@query("metric_gauges", "SELECT event_type AS name, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def metric_gauges(spark, sf_dir):
    return N.gauges(table(spark, sf_dir, "events"), "event_type", "value", "ts", "event_id")


@query("metric_running_gauge", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events")
def metric_running_gauge(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("one", F.lit(1))
    return N.running_gauge(e, "user_id", "one", "ts", "event_id").select("event_id", "value")


_HIST = "SELECT event_type AS name, count(value) AS count, sum(value) AS sum, avg(value) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY 1"


@query("metric_histograms", f"SELECT name, count, round(sum, 4) AS sum, round(mean, 6) AS mean, min, max FROM ({_HIST})")
def metric_histograms(spark, sf_dir):
    h = N.histograms(table(spark, sf_dir, "events"), "event_type", "value")
    return h.withColumns({"sum": F.round("sum", 4), "mean": F.round("mean", 6)})


@query("metric_histogram_text", f"SELECT name, printf('histogram{{count=%d,sum=%.2f,min=%.2f,max=%.2f,mean=%.2f}}', count, sum, min, max, mean) AS text FROM ({_HIST})")
def metric_histogram_text(spark, sf_dir):
    return N.histogram_text(N.histograms(table(spark, sf_dir, "events"), "event_type", "value"))


_TIMES = "SELECT event_type AS name, (user_id * 1000000 + event_id)::BIGINT AS ns FROM events"


@query("metric_timers", f"SELECT name, printf('timer{{count=%d,total_ms=%.3f,avg_ms=%.3f,min_ms=%.3f,max_ms=%.3f}}', count(*), sum(ns / 1e6), avg(ns / 1e6), min(ns / 1e6), max(ns / 1e6)) AS text FROM ({_TIMES}) GROUP BY name")
def metric_timers(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ns", F.col("user_id") * 1000000 + F.col("event_id"))
    return N.timer_text(N.timers(e, "event_type", "ns"))


@query("metric_prometheus", "SELECT string_agg('# HELP ' || name || E' counter metric\\n# TYPE ' || name || E' counter\\n' || name || ' ' || value || E'\\n\\n', '' ORDER BY name) AS text FROM (SELECT event_type AS name, count(*) AS value FROM events GROUP BY 1)")
def metric_prometheus(spark, sf_dir):
    return N.exposition(N.prometheus("counter", N.counters(table(spark, sf_dir, "events"), "event_type")))


@query("metric_prometheus_histogram", "SELECT name, '# HELP ' || name || E' histogram metric\\n# TYPE ' || name || E' histogram\\n' || printf(E'%s_count %d\\n%s_sum %.6f\\n\\n', name, count, name, sum) AS text FROM (" + _HIST + ")")
def metric_prometheus_histogram(spark, sf_dir):
    return N.prometheus("histogram", N.histograms(table(spark, sf_dir, "events"), "event_type", "value"))


@query("metric_json", "SELECT event_type AS name, '{\"value\":' || count(*) || '}' AS json FROM events GROUP BY 1")
def metric_json(spark, sf_dir):
    return N.as_json(N.counters(table(spark, sf_dir, "events"), "event_type"))


@query("metric_requests", "SELECT event_type, count(*) AS total, count_if(value > 20)::BIGINT AS successful, count_if(NOT value > 20)::BIGINT AS failed, min(value) AS min_latency, max(value) AS max_latency, round(avg(value), 6) AS avg_latency, round(100.0 * count_if(value > 20) / count(*), 6) AS success_rate FROM events GROUP BY 1")
def metric_requests(spark, sf_dir):
    r = N.requests(table(spark, sf_dir, "events"), "event_type", "value", F.col("value") > 20)
    return r.withColumns({"avg_latency": F.round("avg_latency", 6), "success_rate": F.round("success_rate", 6)})


# Prompts, models, agents


@query("prompt_format", "SELECT conv_id, turn, 'As ' || role || ': ' || replace(text, '{role}', role) || ' / ' || turn AS prompt FROM conversations")
def prompt_format(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    filled = P.fill("As {role}: {text} / {turn}", {"text": F.col("text"), "role": F.col("role"), "turn": F.col("turn")})
    return c.select("conv_id", "turn", filled.alias("prompt"))


@query("prompt_format_empty", "SELECT conv_id, turn, role || ' said ' AS prompt FROM conversations")
def prompt_format_empty(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.fill("{role} said {nothing}", {"role": F.col("role")}, "empty").alias("prompt"))


@query("prompt_few_shot", "SELECT item_id, E'Classify.\\n\\nQ: a A: b---\\n\\nQ: c A: d---\\n\\nQ: ' || text || E' A: ?\\n\\nEnd' AS prompt FROM benchmark")
def prompt_few_shot(spark, sf_dir):
    shot = P.few_shot("Classify.", [{"q": "a", "a": "b"}, {"q": "c", "a": "d"}], "Q: {q} A: {a}", {"q": F.col("text"), "a": F.lit("?")}, "End", "---")
    return table(spark, sf_dir, "benchmark").select("item_id", shot.alias("prompt"))


@query("prompt_variables", r"SELECT page_id, list_sort(list_distinct(regexp_extract_all('{' || page_id || '} and {b c} ' || html || ' {b c}', '\{([^}]+)\}', 1))) AS names FROM pages")
def prompt_variables(spark, sf_dir):
    t = F.concat(F.lit("{"), F.col("page_id").cast("string"), F.lit("} and {b c} "), "html", F.lit(" {b c}"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_sort(P.variables(t)).alias("names"))


@query("prompt_chat", "SELECT conv_id, string_agg('[' || role || ']: ' || text || E'\\n\\n', '' ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def prompt_chat(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(P.chat_text(*map(F.col, ("turn", "role", "text"))).alias("prompt"))


@query("prompt_chat_json", "SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id")
def prompt_chat_json(spark, sf_dir):
    """Written as JSON and parsed again."""
    j = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(P.chat_json(*map(F.col, ("turn", "role", "text"))).alias("j"))
    m = F.from_json("j", "messages array<struct<role:string,content:string>>")["messages"]
    return j.select("conv_id", m["role"].alias("roles"), m["content"].alias("texts"))


@query("chat_answer", r"SELECT conv_id, 'Mock OpenAI chat response to: ' || string_agg('[' || role || '] ' || text || '\n', '' ORDER BY turn) AS answer FROM conversations GROUP BY conv_id")
def chat_answer(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(P.mock_chat(*map(F.col, ("turn", "role", "text"))).alias("answer"))


@query("prompt_texts", "SELECT item_id, E'Head\\n\\nQ: a A: b---\\n\\n\\n\\nTail' AS shots, E'Step 1:\\nOne {x}\\n\\n---\\n\\nStep 2:\\nTwo' AS steps FROM benchmark")
def prompt_texts(spark, sf_dir):
    shots, steps = P.few_shot_text("Head", [{"q": "a", "a": "b"}], "Q: {q} A: {a}", "Tail", "---"), P.pipeline_text(["One {x}", "Two"])
    return table(spark, sf_dir, "benchmark").select("item_id", F.lit(shots).alias("shots"), F.lit(steps).alias("steps"))


@query("prompt_builders", "SELECT item_id, 'About ' || item_id || ': ' || text AS prompt, true AS valid, false AS bare FROM benchmark")
def prompt_builders(spark, sf_dir):
    t = P.Template.simple("{x}").with_text("About {id}: {text}").with_variable("id").with_variable("text").without_variable("x")
    shown = t.format({"id": F.col("item_id"), "text": F.col("text")})
    return table(spark, sf_dir, "benchmark").select("item_id", shown.alias("prompt"), F.lit(t.is_valid()).alias("valid"), F.lit(t.without_variable("id").is_valid()).alias("bare"))


@query("prompt_loaded", "SELECT item_id, 'From a file: ' || text AS prompt FROM benchmark")
def prompt_loaded(spark, sf_dir):
    path = new_folder(spark, "prompt")
    spark.range(1).select(F.lit("From a file: {text}")).coalesce(1).write.text(path)
    template = load_prompt(spark, f"{path}/*.txt").rstrip("\n")
    return table(spark, sf_dir, "benchmark").select("item_id", P.fill(template, {"text": F.col("text")}).alias("prompt"))


@query("prompt_sanitize", r"SELECT doc_id, trim(regexp_replace(text, '\n{3,}', E'\n\n', 'g'), E' \t\n\r') AS prompt FROM documents")
def prompt_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.sanitize(F.col("text")).alias("prompt"))


@query("prompt_pipeline", "SELECT item_id, 'Final: Step: ' || item_id || ' ' || text || ' done' AS prompt FROM benchmark")
def prompt_pipeline(spark, sf_dir):
    out = P.pipeline(["Step: {id} {text}", "Final: {step_1_result} done"], {"id": F.col("item_id"), "text": F.col("text")})
    return table(spark, sf_dir, "benchmark").select("item_id", out.alias("prompt"))


@query("chain_llm", "SELECT item_id, 'Mock OpenAI response to: Repeat ' || trim(text, E' \\t\\n\\r\\v\\f') AS answer FROM benchmark")
def chain_llm(spark, sf_dir):
    chain = C.LLMChain("Repeat {text}", "answer")
    return chain.run(table(spark, sf_dir, "benchmark")).select("item_id", "answer")


@query("chain_llm_braces", "SELECT item_id, 'Mock OpenAI response to: Repeat keep {this} and {} ' || trim(text, E' \\t\\n\\r\\v\\f') AS answer FROM benchmark")
def chain_llm_braces(spark, sf_dir):
    """Braces that a text has are no variables of the template; one that has no value is empty."""
    b = table(spark, sf_dir, "benchmark").withColumn("text", F.concat(F.lit("keep {this} and {} "), F.btrim("text", F.lit(" \t\n\r\x0b\x0c"))))
    return C.LLMChain("Repeat {text}{nothing}", "answer").run(b).select("item_id", "answer")


def _failing(x):
    """A model that has no answer for texts of an odd number of characters."""
    return F.when(F.length(x) % 2 == 0, P.mock_completion(x))


_CHAIN = [C.LLMChain("{text}", "a", _failing), C.LLMChain("{text}!", "a", lambda x: F.concat(F.lit("then "), x))]


@query("chain_stop_on_error", "SELECT item_id, CASE WHEN len(text) % 2 = 0 THEN 'then ' || trim(text || '!', E' \\t\\n\\r\\v\\f') END AS a, CASE WHEN len(text) % 2 = 1 THEN 'Chain 0 failed' END AS error FROM benchmark")
def chain_stop_on_error(spark, sf_dir):
    return C.sequential(table(spark, sf_dir, "benchmark"), _CHAIN, stop_on_error=True).select("item_id", "a", "error")


@query("chain_go_on", "SELECT item_id, 'then ' || trim(text || '!', E' \\t\\n\\r\\v\\f') AS a, CASE WHEN len(text) % 2 = 1 THEN 'Chain 0 failed' END AS error FROM benchmark")
def chain_go_on(spark, sf_dir):
    return C.sequential(table(spark, sf_dir, "benchmark"), _CHAIN, stop_on_error=False).select("item_id", "a", "error")


@query("chain_registry", "SELECT item_id, 'Mock OpenAI response to: ' || item_id AS answer, 'llm,sequential' AS kinds, 'openai' AS providers FROM benchmark")
def chain_registry(spark, sf_dir):
    chain = C.CHAINS.make("llm", "{item_id}", "answer", C.MODELS.make("openai"))
    out = chain.run(table(spark, sf_dir, "benchmark"))
    return out.select("item_id", "answer", F.lit(",".join(C.CHAINS.names())).alias("kinds"), F.lit(",".join(C.MODELS.names())).alias("providers"))


@query("chain_sequential", "SELECT item_id, 'Mock OpenAI response to: 2 Mock OpenAI response to: 1 ' || item_id || ' of ' || item_id AS answer FROM benchmark")
def chain_sequential(spark, sf_dir):
    first, second = C.LLMChain("1 {item_id}", "draft"), C.LLMChain("2 {draft} of {item_id}", "answer")
    return C.sequential(table(spark, sf_dir, "benchmark"), [first, second]).select("item_id", "answer")


@query("model_chunks", "SELECT item_id, unnest(range(1, len(text) + 1, 5)) AS at, substring(text, unnest(range(1, len(text) + 1, 5)), 5) AS chunk FROM benchmark")
def model_chunks(spark, sf_dir):
    pieces = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(P.chunks(F.col("text"), 5)).alias("i", "chunk"))
    return pieces.select("item_id", (F.col("i").cast("long") * 5 + 1).alias("at"), "chunk")


@query("model_stream", "SELECT item_id, list_transform(range(1, len(t) + 1, 5), lambda i: substring(t, i, 5)) AS pieces FROM (SELECT item_id, 'Mock streaming OpenAI response to: ' || text AS t FROM benchmark)")
def model_stream(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", P.chunks(P.mock_stream(F.col("text")), 5).alias("pieces"))


@query("chat_stream", "SELECT item_id, list_transform(range(1, len(t) + 1, 3), lambda i: substring(t, i, 3)) AS pieces FROM (SELECT item_id, 'Mock streaming OpenAI chat response' AS t FROM benchmark)")
def chat_stream(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", P.chunks(F.lit(P.STREAMED_CHAT), 3).alias("pieces"))


@query("model_support", "SELECT item_id, item_id % 3 < 2 AS supported, item_id % 4 < 3 AS able FROM benchmark")
def model_support(spark, sf_dir):
    i = F.col("item_id")
    name = F.when(i % 3 == 0, "gpt-4").when(i % 3 == 1, "text-ada-001").otherwise("gpt-unknown")
    what = F.when(i % 4 == 0, "chat").when(i % 4 == 1, "streaming").when(i % 4 == 2, "completion").otherwise("multimodal")
    return table(spark, sf_dir, "benchmark").select("item_id", P.is_model_supported(name).alias("supported"), P.can(what).alias("able"))


@query("model_usage", "SELECT item_id, ((strlen(text) + 3) // 4)::BIGINT AS prompt_tokens, ((strlen('Mock OpenAI response to: ' || text) + 3) // 4)::BIGINT AS completion_tokens FROM benchmark")
def model_usage(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", token_count(t).alias("prompt_tokens"), token_count(P.mock_completion(t)).alias("completion_tokens"))


@query("agent_actions", r"SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN role ELSE '' END AS tool, CASE WHEN turn % 4 < 3 THEN regexp_replace(text, '\].*', '', 's') ELSE '' END AS input, turn % 5 = 0 AS final FROM conversations")
def agent_actions(spark, sf_dir):
    """With brackets, without, and without an action."""
    end, turn = F.when(F.col("turn") % 5 == 0, "Final Answer: x").otherwise(""), F.col("turn")
    act = F.when(turn % 4 < 3, F.concat(F.lit("Action: "), "role", F.lit(" ["), "text", F.lit("]\n"))).otherwise("no more")
    said = F.concat(F.lit("Thought: look\n"), act, end)
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", P.action(said).alias("a"), P.is_final(said).alias("final"))
    return found.select("conv_id", "turn", "a.tool", "a.input", "final")


@query("agent_tools", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'length ' || length(text) ELSE 'Error: Tool not found: none' END AS observation FROM benchmark")
def agent_tools(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("tool", F.when(F.col("item_id") % 2 == 0, "length").otherwise("none"))
    return C.tools(b, {"length": lambda x: F.concat(F.lit("length "), F.length(x).cast("string"))}, argument="text").select("item_id", "observation")


@query("enum_names", "SELECT conv_id, turn, CASE WHEN role IN ('system', 'user', 'assistant', 'function', 'tool') THEN role ELSE 'user' END AS role, ['LOW', 'NORMAL', 'HIGH', 'CRITICAL', 'NORMAL'][turn % 5 + 1] AS priority, ['PENDING', 'RUNNING', 'COMPLETED', 'FAILED', 'CANCELLED', 'PENDING'][turn % 6 + 1] AS status FROM conversations")
def enum_names(spark, sf_dir):
    """Every known name and one that is not."""
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("turn") % len(names) + 1).cast("int"))
    p, s = pick("LOW", "NORMAL", "HIGH", "CRITICAL", "other"), pick("PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED", "other")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.known_role(F.col("role")).alias("role"), P.priority_name(p).alias("priority"), P.status_name(s).alias("status"))


# Security, logs, roles

_MAIL = "c_name || '@mail.com'"


@query("security_checks", rf"SELECT c_custkey, regexp_full_match({_MAIL}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}') AS email, strlen(c_name) >= 8 AND regexp_matches(c_name, '[A-Z]') AND regexp_matches(c_name, '[a-z]') AND regexp_matches(c_name, '[0-9]') AND regexp_matches(c_name, '[[:punct:]]') AS strong, CASE WHEN c_name = 'Customer#000000001' THEN 'true' ELSE 'false' END AS same FROM customer")
def security_checks(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", X.is_valid_email(F.concat(n, F.lit("@mail.com"))).alias("email"), X.is_strong_password(n).alias("strong"), X.secure_compare(n, F.lit("Customer#000000001")).alias("same"))


@query("security_hashes", "SELECT c_custkey, sha256(c_name) AS hash, sha256(c_mktsegment || c_name) AS salted, true AS verified FROM customer")
def security_hashes(spark, sf_dir):
    n, salt = F.col("c_name"), F.col("c_mktsegment")
    salted = X.hash_password(n, salt)
    return table(spark, sf_dir, "customer").select("c_custkey", X.sha256(n).alias("hash"), salted.alias("salted"), X.verify_password(n, salt, salted).alias("verified"))


_PAD = lambda x: "".join(f"{b ^ x:02X}" for b in b"key".ljust(64, b"\0"))


@query("security_hmac", f"SELECT c_custkey, sha256(unhex('{_PAD(0x5C)}') || unhex(sha256(unhex('{_PAD(0x36)}') || encode(c_name)))) AS hmac FROM customer")
def security_hmac(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.hmac_sha256(b"key", F.col("c_name")).alias("hmac"))


@query("security_encryption", "SELECT c_custkey, c_name AS back FROM customer")
def security_encryption(spark, sf_dir):
    key = X.derive_key(F.lit("password"), F.lit("salt"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.decrypt(X.encrypt(F.col("c_name"), key), key).alias("back"))


@query("security_sanitize", r"""SELECT page_id, regexp_replace(html, '[^\x20-\x7E]|[<>&"'']', '', 'g') AS clean FROM pages""")
def security_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.sanitize_input(F.col("html")).alias("clean"))


@query("audit_range", "SELECT event_id FROM events WHERE user_id = 5 AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def audit_range(spark, sf_dir):
    return A.logs(table(spark, sf_dir, "events"), 5, "2024-01-03 00:00:00", "2024-01-20 00:00:00").select("event_id")


@query("audit_search", "SELECT event_id FROM events WHERE contains(event_type, 'k') OR contains(props, 'k')")
def audit_search(spark, sf_dir):
    return A.search_logs(table(spark, sf_dir, "events"), "k", ("event_type", "props")).select("event_id")


@query("audit_failed_logins", "SELECT event_id FROM events WHERE event_type = 'click' AND value < 10")
def audit_failed_logins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.withColumn("action", F.when(F.col("event_type") == "click", "LOGIN").otherwise("VIEW")).withColumn("result", F.when(F.col("value") < 10, "FAILED").otherwise("OK"))
    return A.failed_logins(log).select("event_id")


@query("audit_purge", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'")
def audit_purge(spark, sf_dir):
    return A.purge(table(spark, sf_dir, "events"), "2024-01-10 00:00:00").select("event_id")


@query("rbac_permitted", "SELECT c_custkey AS user_id, n_regionkey AS resource FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 = n_regionkey")
def rbac_permitted(spark, sf_dir):
    roles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("role_id"))
    permissions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("role_id"), F.col("n_regionkey").alias("resource"), F.lit("READ").alias("type"))
    asked = roles.select("user_id", (F.col("user_id") % 5).cast("int").alias("resource"), F.lit("READ").alias("type"))
    return A.permitted(asked, roles, permissions).select("user_id", "resource")


@query("sessions_valid", "SELECT event_id, ts + INTERVAL 1 HOUR >= TIMESTAMP '2024-01-10 00:00:00' AS valid FROM events")
def sessions_valid(spark, sf_dir):
    return A.sessions(table(spark, sf_dir, "events"), "2024-01-10 00:00:00").select("event_id", "valid")


_USERS = """(SELECT c_custkey AS user_id, c_name AS username, sha256('s' || c_mktsegment) AS password_hash, 's' AS salt, c_custkey % 7 <> 0 AS active, c_custkey % 11 = 0 AS locked FROM customer)"""


def _users(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    hashed, key = X.hash_password(F.col("c_mktsegment"), F.lit("s")), F.col("c_custkey")
    return c.select(key.alias("user_id"), F.col("c_name").alias("username"), hashed.alias("password_hash"), F.lit("s").alias("salt"), (key % 7 != 0).alias("active"), (key % 11 == 0).alias("locked"))


@query("users_created", f"SELECT user_id, username FROM {_USERS} UNION ALL VALUES (-2, 'new one')")
def users_created(spark, sf_dir):
    """A name that is taken is not created again."""
    users = _users(spark, sf_dir)
    new = users.limit(1).withColumns({"user_id": F.lit(-2).cast("long"), "username": F.lit("new one")})
    return A.create(users, users.withColumn("user_id", F.lit(-1).cast("long")).unionByName(new), "username").select("user_id", "username")


@query("users_updated", f"SELECT user_id, user_id % 5 = 0 AS locked FROM {_USERS}")
def users_updated(spark, sf_dir):
    users = _users(spark, sf_dir)
    plain = users.withColumn("locked", F.lit(False))
    changes = users.filter("user_id % 5 = 0").withColumn("locked", F.lit(True)).unionByName(users.limit(1).withColumn("username", F.lit("nobody")))
    return A.update(plain, changes, "username").select("user_id", "locked")


@query("users_removed", f"SELECT user_id FROM {_USERS} WHERE user_id % 5 <> 0")
def users_removed(spark, sf_dir):
    users = _users(spark, sf_dir)
    return A.remove(users, users.filter("user_id % 5 = 0"), "username").select("user_id")


@query("logins_authenticated", f"SELECT username, CASE WHEN active AND NOT locked AND user_id % 3 <> 0 THEN user_id END AS user_id, CASE WHEN active AND NOT locked AND user_id % 3 <> 0 THEN TIMESTAMP '2024-01-01 01:00:00' END AS expires_at FROM {_USERS} UNION ALL VALUES ('nobody', NULL, NULL)")
def logins_authenticated(spark, sf_dir):
    """Every third login has a wrong password, one an unknown name."""
    c = table(spark, sf_dir, "customer")
    password = F.when(F.col("c_custkey") % 3 == 0, "wrong").otherwise(F.col("c_mktsegment"))
    logins = c.select(F.col("c_name").alias("username"), password.alias("password")).union(c.limit(1).select(F.lit("nobody"), F.lit("x")))
    return A.authenticate(logins.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")), _users(spark, sf_dir)).select("username", "user_id", "expires_at")


@query("request_headers", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS token, c_custkey % 3 = 0 AS public, strlen(c_name) >= 16 AS csrf FROM customer")
def request_headers(spark, sf_dir):
    n, key = F.col("c_name"), F.col("c_custkey")
    header = F.concat(F.when(key % 2 == 0, "Bearer ").otherwise("Basic "), n)
    path = F.when(key % 3 == 0, "/health/now").otherwise("/private/health")
    return table(spark, sf_dir, "customer").select("c_custkey", X.bearer(header).alias("token"), X.is_public(path, ["/health", "/login"]).alias("public"), X.is_csrf_token(n).alias("csrf"))


@query("random_values", "SELECT c_custkey, 12 AS n, true AS differ, true AS csrf, true AS id FROM customer")
def random_values(spark, sf_dir):
    """What can be told of values drawn at random: their length and form."""
    out = table(spark, sf_dir, "customer").select("c_custkey", X.random_string(12).alias("a"), X.csrf_token().alias("b"), X.new_id().alias("c"))
    form = F.col("c").rlike(r"\Aid_[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z")
    return out.select("c_custkey", F.length("a").alias("n"), (F.col("a") != F.col("b")).alias("differ"), X.is_csrf_token(F.col("b")).alias("csrf"), form.alias("id"))


# Configurations, collections, saved conversations


@query("collections_lifecycle", "SELECT * FROM (VALUES ('a', true, false, true), ('b', true, false, false)) v(collection, created, again, there)")
def collections_lifecycle(spark, sf_dir):
    s = Collections(spark, new_folder(spark, "collections"))
    made = {n: (s.create(n), s.create(n)) for n in ("a", "b")}
    s.save("a", table(spark, sf_dir, "region"))
    s.drop("b")
    there = set(s.names())
    rows = " UNION ALL ".join(f"SELECT '{n}' AS collection, {x} AS created, {y} AS again, {n in there and s.is_healthy()} AS there" for n, (x, y) in made.items())
    return spark.sql(rows)


@query("collections_stats", "SELECT 'nation' AS collection, true AS files, true AS bytes, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM nation) AS n_names")
def collections_stats(spark, sf_dir):
    from quern.sources.collections import shape

    s = Collections(spark, new_folder(spark, "collections"))
    s.save("nation", table(spark, sf_dir, "nation"))
    s.append("nation", table(spark, sf_dir, "nation").limit(0))
    other = Collections(spark, new_folder(spark, "restored"))
    other.restore(s.base)
    n = shape(other.load("nation", "n_nationkey int, n_name string"))
    return other.stats().select("collection", (F.col("files") > 0).alias("files"), (F.col("bytes") > 0).alias("bytes")).crossJoin(F.broadcast(n.select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("n_names"))))


@query("config_store", "SELECT * FROM (VALUES ('bm25', 'BM25Config', 2.0::DOUBLE), ('memory', 'MemoryConfig', 7.0)) v(id, kind, value)")
def config_store(spark, sf_dir):
    """Settings saved, replaced, listed, deleted and read again as their own class."""
    s = Collections(spark, new_folder(spark, "configs"))
    for i, c in (("bm25", BM25Config()), ("bm25", BM25Config(k1=2.0)), ("memory", MemoryConfig(max_messages=7)), ("gone", IndexConfig())):
        s.save_config(i, c)
    s.discard("configs", "gone")
    found = [(i, s.config(i)) for i in s.entries("configs")]
    assert s.config("gone") is None and found[0][1] == BM25Config(k1=2.0)
    return spark.sql(" UNION ALL ".join(f"SELECT '{i}' AS id, '{type(c).__name__}' AS kind, CAST({getattr(c, 'k1', 0) or c.max_messages} AS DOUBLE) AS value" for i, c in found))


@query("index_metadata_store", "SELECT 'docs / main' AS index_id, (SELECT count(*) FROM documents) AS n_docs")
def index_metadata_store(spark, sf_dir):
    s = Collections(spark, new_folder(spark, "indexes"))
    n = table(spark, sf_dir, "documents").count()
    s.put("indexes", "docs / main", {"index_id": "docs / main", "n_docs": n})
    s.put("indexes", "other", {"index_id": "other", "n_docs": 0})
    s.discard("indexes", "other")
    held = [s.entry("indexes", i) for i in s.entries("indexes")]
    return spark.sql(" UNION ALL ".join(f"SELECT '{x['index_id']}' AS index_id, {x['n_docs']}L AS n_docs" for x in held))


@query("conversations_saved", "SELECT conv_id, turn, text FROM conversations WHERE conv_id = 3")
def conversations_saved(spark, sf_dir):
    path = new_folder(spark, "conversations")
    M.save(table(spark, sf_dir, "conversations"), path)
    return M.load(spark, path, 3).select("conv_id", "turn", "text")


@query("memory_context_times", rf"""SELECT conv_id, string_agg('[' || {_NAME} || ']: ' || text || ' (at ' || strftime(t, '%a %b ') || lpad(day(t)::VARCHAR, 2, ' ') || strftime(t, ' %H:%M:%S %Y') || E')\n', '' ORDER BY turn) AS context FROM (SELECT *, TIMESTAMP '2024-01-08 23:30:05' + INTERVAL 1 HOUR * turn AS t FROM conversations) GROUP BY conv_id""")
def memory_context_times(spark, sf_dir):
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-08 23:30:05").cast("timestamp")) + F.col("turn") * 3600)
    return M.context(table(spark, sf_dir, "conversations").withColumn("at", at), ts="at")


@query("memory_basic_summary", "SELECT conv_id, 'Summary of ' || count(*) || ' messages.' AS summary FROM conversations GROUP BY conv_id")
def memory_basic_summary(spark, sf_dir):
    return M.basic_summaries(table(spark, sf_dir, "conversations"))


@query("memory_kinds", """SELECT 'buffer' AS kind, conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4
UNION ALL SELECT 'summary', conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= count(*) OVER (PARTITION BY conv_id) % 10
UNION ALL SELECT 'token_buffer', conv_id, turn FROM conversations QUALIFY sum((strlen(text) + 3) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 120""")
def memory_kinds(spark, sf_dir):
    from functools import reduce

    c = table(spark, sf_dir, "conversations")
    parts = [M.remembered(k, c, _LAST).select(F.lit(k).alias("kind"), "conv_id", "turn") for k in sorted(M.MEMORIES)]
    return reduce(lambda a, b: a.union(b), parts)


_GAUGE = "SELECT event_type AS name, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1"


@query("metric_texts", f"SELECT name, 'counter{{value=' || (SELECT count(*) FROM events e WHERE e.event_type = g.name) || '}}' AS counter, printf('gauge{{value=%.2f}}', value) AS gauge FROM ({_GAUGE}) g")
def metric_texts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    counter = N.counter_text(N.counters(e, "event_type")).withColumnRenamed("text", "counter")
    return counter.join(N.gauge_text(N.gauges(e, "event_type", "value", "ts", "event_id")).withColumnRenamed("text", "gauge"), "name")


@query("metric_prometheus_gauge", "SELECT name, '# HELP ' || name || E' gauge metric\\n# TYPE ' || name || E' gauge\\n' || printf(E'%s %.6f\\n\\n', name, value) AS text FROM (" + _GAUGE + ")")
def metric_prometheus_gauge(spark, sf_dir):
    return N.prometheus("gauge", N.gauges(table(spark, sf_dir, "events"), "event_type", "value", "ts", "event_id"))


@query("metric_prometheus_timer", "SELECT name, '# HELP ' || name || E' timer metric\\n# TYPE ' || name || E' histogram\\n' || printf(E'%s_count %d\\n%s_sum %.6f\\n\\n', name, count(*), name, sum(ns / 1e6) / 1000) AS text FROM (" + _TIMES + ") GROUP BY name")
def metric_prometheus_timer(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ns", F.col("user_id") * 1000000 + F.col("event_id"))
    return N.prometheus("timer", N.timers(e, "event_type", "ns"))


# JSON


@query("json_kinds", "SELECT event_id, ['object', 'array', 'string', 'number', 'boolean', 'null', NULL][event_id % 7 + 1] AS kind, event_id % 7 < 6 AS there FROM events")
def json_kinds(spark, sf_dir):
    values = ("{}", "[1]", '"x"', "1.5", "true", "null")
    text = F.coalesce(*[F.when(F.col("event_id") % 7 == i, f'{{"a":{{"b":{v}}}}}') for i, v in enumerate(values)], F.lit('{"a":1}'))
    return table(spark, sf_dir, "events").select("event_id", J.kind(text, "$.a.b").alias("kind"), J.contains(text, "$.a.b").alias("there"))


@query("json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.k') AS has_k FROM events")
def json_path(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", J.at(p, "$.k", "long").alias("k"), J.contains(p, "$.k").alias("has_k"))


@query("json_dump", "SELECT event_id, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS json FROM events")
def json_dump(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", J.dump(id=F.col("event_id"), kind=F.col("event_type")).alias("json"))


# Streams: the batch tables read as streams, to their end


def _streamed(spark, sf_dir: str, name: str):
    """A stream reads folders: that of the table's files, or the one in which the table is a file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    inside = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return reader.parquet(str(path.toString())) if inside else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _to_end(df):
    """The complete result of a stream, written by each batch in place of the one before."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, "stream")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/rows")
    q = df.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    out = _to_end(G.windowed_metrics(_streamed(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "count", F.round("sum", 4).alias("sum"), "min", "max")


@query("stream_index", f"WITH {S.index_ctes(IndexConfig())} SELECT term, df, ttf FROM terms")
def stream_index(spark, sf_dir):
    """Postings that a stream appended give the statistics of the whole table."""
    path = new_folder(spark, "index")
    c = IndexConfig()
    q = _streamed(spark, sf_dir, "documents").writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(G.index_batches(c, path)).trigger(availableNow=True).start()
    q.awaitTermination()
    stats = spark.read.parquet(f"{path}/doc_stats")
    whole = I.Index(spark.read.parquet(f"{path}/postings").drop("batch"), stats.drop("batch"), I._corpus(stats), c)
    return whole.term_stats().select("term", "df", "ttf")
