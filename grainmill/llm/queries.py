"""The registered queries of the operators, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import read
from grainmill.llm.decontaminate import decontaminate
from grainmill.llm.hard_negatives import hard_negatives
from grainmill.llm.lexical_search import lexical_search
from grainmill.llm.licenses import license_scan
from grainmill.llm.line_dedup import line_dedup
from grainmill.llm.main_text import extract
from grainmill.llm.near_dedup import near_dedup
from grainmill.llm.packing import pack
from grainmill.llm.quality import quality_rules
from grainmill.llm.quality_classifier import quality_scores
from grainmill.llm.substring_dedup import substring_dedup
from grainmill.llm.token_files import token_files
from grainmill.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Rows of an Arrow batch: documents may be long, so batches are short.
BATCH_ROWS = "1000"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


@query("op2_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents", "doc_id", "text"), size=2, percent=80)


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read(spark, sf_dir, "documents", "doc_id", "text"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

@query("op1_main_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages", "page_id", "url", "html")).drop("n_blocks")


_OP4_SQL = rf"""
with b as (select item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(10, len(w)) n, array_to_string(w[i:i + 9], ' ') win from b, unnest(range(1, greatest(1, len(w) - 9) + 1)) t(i) where len(w) > 0),
d as (select doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') win from d, (select distinct n from bw) s, unnest(range(1, len(w) - n + 2)) t(i)),
m as (select doc_id, i, dw.n, item_id from dw join bw using (win)),
h as (select doc_id, count(distinct p) n_hit from m, unnest(range(i, i + n)) t(p) group by doc_id),
o as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct doc_id, cast(item_id as varchar) item from m) group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (doc_id) left join o using (doc_id)"""


@query("op4_decontaminate", _OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"), size=10)
    return found.drop("hit_spans")


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))


@query("op7_licenses")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.withColumn("notice_ids", F.concat_ws(",", "notice_ids"))


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"), room=1024)


_OP10_SQL = f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) pos from documents),
k as (select *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} key from l),
c as (select key, min(doc_id) keeper from k where length(key) >= 10 group by key having min(doc_id) < max(doc_id)),
j as (select k.*, coalesce(k.doc_id > c.keeper, false) gone from k left join c using (key))
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256
from j group by doc_id"""


@query("op10_line_dedup", _OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(read(spark, sf_dir, "documents", "doc_id", "text"), min_chars=10, min_docs=2)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_OP11_TERMS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP11_SQL = f"""
with d as (select row_number() over () r, doc_id, {_OP11_TERMS} w from documents where text is not null), s as (select count(*) n, sum(len(w)) l from d where len(w) > 0),
i as (select item_id, unnest({_OP11_TERMS}) t from benchmark), q as (select item_id, t, count(*) c from i group by all),
f as (select r, t, count(*) tf from (select r, unnest(w) t from d) where t in (select t from i) group by all),
df as (select t, cast(floor(1000 * ln((2.0 * any_value(n) + 2) / (2 * count(*) + 1))) as bigint) w from f, s group by t),
p as (select doc_id, r, t, df.w * (1000000000 * tf // (1000 * tf + 8 * (25 + (75 * len(d.w) * n) // l))) v from f join df using (t) join d using (r), s),
x as (select item_id, r, doc_id, cast(sum(c * v) as bigint) score from q join p using (t) group by all having sum(c * v) > 0)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) rank, doc_id, score from x
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10"""


@query("op11_lexical_search", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"), k=10)


_OP13_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id a, b.vec_id b, a.label = b.label same, cast(list_inner_product(a.q, b.q) as bigint) s from v a, v b where a.vec_id % 50 = 0),
p as (select a, b p, s ps from s where same and a is distinct from b qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (select p.a, p, ps, b n, s ns, row_number() over (partition by p.a, p order by s desc, b) rank from p join s on s.a = p.a and not same and 50 * ps <= 100 * s and 100 * s <= 95 * ps)
select a anchor_id, p positive_id, cast(rank as int) rank, n negative_id, ps positive_score, ns negative_score from n where rank <= 3"""


@query("op13_hard_negatives", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    changed = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(changed, anchor=lambda i: i % 50 == 0)


@query("op12_quality_classifier")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))
