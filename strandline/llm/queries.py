"""One query per operator over the whole tables, and their SQL where DuckDB can state them."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, ctw, decontaminate, langid, near_dup, pii, quality, resample, sort_means, token_files, tool_calls, toxicity, url_filter
from strandline.llm.store import crc_mod
from strandline.session import ship


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is: in ``STRANDLINE_TOKENIZERS`` or the installed collection."""
    folder = os.environ.get("STRANDLINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def secret() -> str:
    """The key of surrogates: in ``STRANDLINE_PII_KEY``, else a new one for this run."""
    return os.environ.get("STRANDLINE_PII_KEY") or secrets.token_hex(16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_bpe(spark, sf_dir):
    done = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"), keep=["doc_id"], both=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


SCHEMAS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "lookup": {"properties": {"key": {"type": "string"}}, "required": ["key"]},
}


def tool_turns(conversations: DataFrame) -> DataFrame:
    """The conversations table, which holds no calls, with some turns as calls and results (stated again in the SQL).

    By the length L of its text, an assistant turn t makes two calls (L % 3 <> 0): ``c{t}a`` to ``search``, which
    refers to ``c{t-2}b`` (L % 3 = 1) and lacks its query (L % 5 = 0), and ``c{t}b`` to ``lookup`` or an unknown tool
    (L % 4 = 0), which refers to ``c{t-2}a`` (L % 2 = 0) or ``c{t}a`` and repeats the id ``c{t}a`` (L % 11 = 0). A user
    turn behind the first becomes the result of ``c{t-1}a`` (L % 2 = 0) or ``c{t-1}b`` (L % 4 = 1).
    """
    n, turn = F.coalesce(F.length("text"), F.lit(0)), F.col("turn")

    def name(back: int, letter: str):
        return F.concat(F.lit("c"), (turn - back).cast("string"), F.lit(letter))

    query = F.when(n % 3 == 1, F.concat(F.lit("$"), name(2, "b"))).otherwise(F.concat(F.lit("q"), n.cast("string")))
    search = F.when(n % 5 == 0, F.lit('{"limit": "many"}')).otherwise(F.concat(F.lit('{"query": "'), query, F.lit('", "limit": '), (n % 7).cast("string"), F.lit(".0}")))
    key = F.concat(F.lit("$"), F.when(n % 2 == 0, name(2, "a")).otherwise(name(0, "a")))
    first = F.concat(F.lit('{"id": "'), name(0, "a"), F.lit('", "name": "search", "arguments": '), search, F.lit("}"))
    tool = F.when(n % 4 == 0, "guess").otherwise("lookup")
    second = F.concat(F.lit('{"name": "'), tool, F.lit('", "id": "'), F.when(n % 11 == 0, name(0, "a")).otherwise(name(0, "b")), F.lit('", "arguments": {"key": "'), key, F.lit('"}}'))
    calls = F.concat(F.lit('{"content": null, "tool_calls": ['), first, F.lit(", "), second, F.lit("]}"))
    answers = (F.col("role") == "user") & (turn > 0) & ((n % 2 == 0) | (n % 4 == 1))
    result = F.to_json(F.struct(F.when(n % 2 == 0, name(1, "a")).otherwise(name(1, "b")).alias("tool_call_id"), F.col("text").alias("content")))
    text = F.when((F.col("role") == "assistant") & (n % 3 != 0), calls).when(answers, result).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", F.when(answers, "tool").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op4_tool_calls(spark, sf_dir):
    return tool_calls.linked(tool_turns(table(spark, sf_dir, "conversations")), SCHEMAS)


def op5_pii(spark, sf_dir):
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), secret())


def op6_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.train(docs))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_ctw(spark, sf_dir):
    return ctw.score(table(spark, sf_dir, "documents"))


def op9_token_files(spark, sf_dir):
    return token_files.read_documents(token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


#: Words in the name of a host that make it, and what is below it, an entry of the list of op11.
LISTED_WORDS = ["ads", "adult", "bets", "casino", "pills", "spam"]
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op11_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.judged(pages, RULES, url_filter.named_hosts(pages, LISTED_WORDS))


def op12_resample(spark, sf_dir):
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sort_means(spark, sf_dir):
    return sort_means.sort_means(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_bpe, op3_quality, op4_tool_calls, op5_pii, op6_langid, op7_near_dup, op8_ctw, op9_token_files, op10_toxicity, op11_url_filter, op12_resample, op13_sort_means)}

_WORDS = "list_filter(string_split_regex(coalesce({}, ''), '[ \\t-\\r]+'), lambda x: x <> '')"

ORACLE = {}

ORACLE["op1_decontaminate"] = f"""
with d as (select doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
b as (select item_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from benchmark),
ds as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')) when len(w) > 0 then [list_aggregate(w, 'string_agg', ' ')] else [] end) s from d),
bs as (select distinct item_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')) when len(w) > 0 then [list_aggregate(w, 'string_agg', ' ')] else [] end) s from b),
n as (select item_id, count(*) n from bs group by item_id)
select doc_id, item_id, n as n_item_shingles, count(*) as n_shared, count(*) / n as containment
from ds join bs using (s) join n using (item_id) group by doc_id, item_id, n having 100 * count(*) >= 75 * n
"""

ORACLE["op4_tool_calls"] = """
with recursive m as (select row_number() over () as row, conv_id, turn, role, text, coalesce(length(text), 0) as n from conversations),
t as (select *, role = 'assistant' and n % 3 <> 0 as calls, role = 'user' and turn > 0 and (n % 2 = 0 or n % 4 = 1) as answers,
  'c' || (turn - 1) || case when n % 2 = 0 then 'a' else 'b' end as answered from m),
c as (select row, conv_id, turn, 0 as place, 'c' || turn || 'a' as id, 'search' as name,
    case when n % 5 = 0 then '{"limit":"many"}' else '{"limit":' || (n % 7) || ',"query":"' || case when n % 3 = 1 then '$c' || (turn - 2) || 'b' else 'q' || n end || '"}' end as arguments,
    case when n % 5 = 0 then ['missing query', 'type of limit'] else [] end as problems,
    case when n % 5 <> 0 and n % 3 = 1 then ['c' || (turn - 2) || 'b'] else [] end as refs from t where calls
  union all
  select row, conv_id, turn, 1, 'c' || turn || case when n % 11 = 0 then 'a' else 'b' end, case when n % 4 = 0 then 'guess' else 'lookup' end,
    '{"key":"$c' || case when n % 2 = 0 then turn - 2 else turn end || 'a"}', case when n % 4 = 0 then ['unknown tool'] else [] end,
    ['c' || case when n % 2 = 0 then turn - 2 else turn end || 'a'] from t where calls),
e as (select distinct conv_id, id, unnest(refs) as ref from c),
known as (select distinct conv_id, id from c),
p as (select conv_id, id, id as at, 0 as depth from known
  union all select p.conv_id, p.id, e.ref, depth + 1 from p join e on e.conv_id = p.conv_id and e.id = p.at where depth < 60),
l as (select p.conv_id, p.id, case when max(depth) < 60 and count(known.id) = count(*) then max(depth) end as level
  from p left join known on known.conv_id = p.conv_id and known.id = p.at group by p.conv_id, p.id),
r as (select conv_id, answered as id, arg_min(text, turn) as result from t where answers group by conv_id, answered),
x as (select c.*, level, result, r.id is not null as found from c left join l on l.conv_id = c.conv_id and l.id = c.id left join r on r.conv_id = c.conv_id and r.id = c.id),
j as (select row, count(*) as n_calls, count(*) filter (len(problems) = 0) as n_valid, count(*) filter (found) as n_linked,
  string_agg('{"arguments":' || arguments || ',"id":"' || id || '","level":' || coalesce(level::varchar, 'null') || ',"name":"' || name || '","place":' || place || ',"problems":' || to_json(problems)
    || ',"refs":' || to_json(refs) || ',"result":' || coalesce(to_json(result)::varchar, 'null') || '}', ',' order by place) as body from x group by row)
select t.conv_id, turn, case when answers then 'tool' else role end as role, coalesce(n_calls, 0) as n_calls, coalesce(n_valid, 0) as n_valid,
  case when answers then (known.id is not null)::bigint else coalesce(n_linked, 0) end as n_linked,
  case when calls then '{"content":null,"role":"assistant","tool_calls":[' || body || '],"turn":' || turn || '}'
    when answers then '{"content":' || to_json(text) || ',"role":"tool","tool_call_id":"' || answered || '","turn":' || turn || '}'
    else '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"turn":' || turn || '}' end as json
from t left join j using (row) left join known on answers and known.conv_id = t.conv_id and known.id = t.answered
"""


def _quality_sql() -> str:
    """The rules over lists; references as literal values."""
    refs = []
    for lang in sorted(quality.CLASS_SHARES):
        words = quality.COMMON_WORDS[lang]
        shares = [*words.values(), 1 - sum(words.values())]
        refs.append("{'lang': '%s', 'classes': %s, 'words': %s, 'shares': %s}" % (lang, [float(x) for x in quality.CLASS_SHARES[lang]], list(words), [float(x) for x in shares]))
    listed = sorted({w for v in quality.COMMON_WORDS.values() for w in v})
    forms = [f + end for w in listed for f in (w, w.capitalize()) for end in ("", ".", ",")]

    def distance(counts, shares):
        p = f"(c / nullif(list_sum({counts}), 0))"
        term = f"(case when {p} > 0 then {p} * log2({p} / (({p} + {shares}[i]) / 2)) else 0 end + case when {shares}[i] > 0 then {shares}[i] * log2({shares}[i] / ((coalesce({p}, 0) + {shares}[i]) / 2)) else 0 end)"
        return f"sqrt(greatest(list_sum(list_transform({counts}, lambda c, i: {term})) / 2, 0))"

    return f"""
with w as (select doc_id, lang, coalesce(text, '') as text, {_WORDS.format("text")} as words from documents),
m as (select *, len(words) as n, array_to_string(words, '') as solid from w),
c as (select *, length(solid) as word_chars, regexp_replace(solid, '[a-z]+', '', 'g') as rest,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) as lines,
  case when n >= 5 then list_transform(range(1, n - 3), lambda i: array_to_string(words[i:i+4], ' ')) else [] end as windows from m),
win as (select doc_id, unnest(windows) as g, generate_subscripts(windows, 1) as i from c),
again as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
covered as (select doc_id, count(distinct i + k) as n_repeat_words from again, range(0, 5) r(k) group by doc_id),
h as (select c.*, coalesce(n_repeat_words, 0) as n_repeat_words,
  [word_chars - length(rest), length(regexp_replace(rest, '[^A-Z]+', '', 'g')), length(regexp_replace(rest, '[^0-9]+', '', 'g')), length(regexp_replace(rest, '[^#*$%&|<>]+', '', 'g')), length(regexp_replace(rest, '[^.,;:!?''"()\\-]+', '', 'g'))] as named,
  list_transform(list_filter(words, lambda x: list_contains({forms}, x)), lambda x: lower(rtrim(x, '.,'))) as picked
  from c left join covered using (doc_id)),
r as (select unnest({'[' + ', '.join(refs) + ']'}) as r),
x as (select h.doc_id, n, word_chars, named, lines, n_repeat_words, n < 10 or 100 * n_repeat_words > 20 * n as failed, list_append(named, word_chars - list_sum(named)) as histogram, picked, r from h, r
  where r.lang = h.lang or h.lang is null or h.lang not in ({', '.join(f"'{k}'" for k in sorted(quality.CLASS_SHARES))})),
y as (select *, list_transform(r.words, lambda q: len(list_filter(picked, lambda z: z = q))) as seen from x),
z as (select *, list_append(seen, n - list_sum(seen)) as counts from y),
d as (select doc_id, any_value(n) as n, any_value(word_chars) as word_chars, any_value(named) as named, any_value(lines) as lines, any_value(n_repeat_words) as n_repeat_words, any_value(failed) as failed,
  min(case when word_chars >= {quality.MIN_CHARS} then {distance("histogram", "r.classes")} end) as class_distance,
  min(case when n >= {quality.MIN_WORDS} then {distance("counts", "r.shares")} end) as word_distance from z group by doc_id)
select doc_id, cast(n as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(named[4] as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, failed as base_failed,
  not failed and coalesce(class_distance, 0) <= {quality.MAX_CLASS_DISTANCE} and coalesce(word_distance, 0) <= {quality.MAX_WORD_DISTANCE} as kept
from d
"""


ORACLE["op3_quality"] = _quality_sql()


ORACLE["op11_url_filter"] = f"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from u),
rules as (select unnest([{", ".join("{'verdict': '%s', 'rule': '%s'}" % r for r in RULES)}], recursive := true)),
fit as (select host, path, max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) as best from (select distinct host, path from h), rules
  where (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, strpos(rule, '/'))) group by host, path)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, case when list_has_any(string_split_regex(host, '[.-]'), {LISTED_WORDS}) then 'block' else 'allow' end) as verdict
from h left join fit using (host, path)
"""

_FEATURES = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE["op12_resample"] = f"""
with tab as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as t from range(256) r(i)),
d as (select row_number() over () as row, doc_id, {_FEATURES} as w from documents),
b as (select {_FEATURES} as w from benchmark),
dw as (select row, unnest(w) as f from d), bw as (select unnest(w) as f from b),
f as (select f, hex(encode(f)) as x from (select distinct f from (select f from dw union all select f from bw))),
k as (select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint)), lambda c, y: xor(c // 256, t[1 + xor(c, y) % 256])), 4294967295) % 10000 as bucket from f, tab),
s as (select bucket, count(*) as s from dw join k using (f) group by bucket), t as (select bucket, count(*) as t from bw join k using (f) group by bucket),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from dw) + 10000) / ((coalesce(s, 0) + 1)::double * ((select count(*) from bw) + 10000))))::bigint as gain
  from range(10000) r(bucket) left join s using (bucket) left join t using (bucket)),
m as (select row, sum(gain) as weight from dw join k using (f) join g using (bucket) group by row),
x as (select row, doc_id, len(w) as n_features, coalesce(weight, 0)::bigint as weight, (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5)::double / 4294967296 as u from d left join m using (row)),
y as (select *, weight + floor(-1000 * ln(-ln(u)))::bigint as score from x),
z as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end as place, count(*) filter (n_features >= 20) over () as n from y)
select doc_id, n_features, weight, score, case when place <= 10 * n // 100 then place end as rank from z
"""


def _sort_means_sql(rounds: int = 3) -> str:
    """The rounds as one relation each: distances to all centroids, the nearest, the floored means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} as (select vec_id, v, min(struct_pack(distance := list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, cluster := cluster)) as best from e, c{r} group by row, vec_id, v),
s{r} as (select best.cluster as cluster, i, floor(sum(v[i]) / count(*))::bigint as x from a{r}, range(1, 65) g(i) group by all),
c{r + 1} as (select c{r}.cluster, coalesce(own.m, c{r}.m) as m from c{r} left join (select cluster, list(x order by i) as m from s{r} group by cluster) own using (cluster))""")
    return f"""
with e as (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select (row_number() over (order by sha256('1:' || vec_id)) - 1)::int as cluster, v as m from e order by sha256('1:' || vec_id) limit 16),
{", ".join(steps)}
select vec_id, best.cluster as cluster, best.distance as distance, (sum(best.distance) over (partition by best.cluster))::bigint as cluster_inertia, (sum(best.distance) over ())::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} join c{rounds} on c{rounds}.cluster = best.cluster
"""


ORACLE["op13_sort_means"] = _sort_means_sql()
