"""Topic labels and text scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.functions import text as X
from veridict.operators import topics as T
from veridict.plans import query
from veridict.sources.tables import part_topics, table

CATEGORIES = ["ECONOMY", "Promo", "Standard & Co"]
OVERRIDES = {"small": "Standard & Co"}


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = part_topics(spark, sf_dir)
    # make some labels null, blank, combined and differently spelt
    k = F.col("question_id") % 11
    label = (
        F.when(k == 0, None).when(k == 1, "  ").when(k == 2, F.concat(F.col("topic"), F.lit(" / MEDIUM")))
        .when(k == 3, F.concat(F.lit(" "), F.lower("topic"), F.lit("!"))).otherwise(F.col("topic"))
    )
    return T.map_topics(topics.withColumn("topic", label), "topic", CATEGORIES, OVERRIDES, drop=["large"], misc="MISC", combined_to_misc=True)


_LABELS = r"""labels_ AS (
    SELECT p_partkey AS question_id, p_brand AS generator, p_size, CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '  '
        WHEN 2 THEN p_type || ' / MEDIUM' WHEN 3 THEN ' ' || lower(p_type) || '!' ELSE p_type END AS topic FROM part),
normal AS (SELECT *, trim(regexp_replace(replace(lower(trim(topic)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS n FROM labels_),
mapped_ AS (SELECT *, CASE
        WHEN topic IS NULL THEN 'none' WHEN trim(topic) = '' THEN 'empty' WHEN n = 'large' THEN 'dropped'
        WHEN topic IN ('ECONOMY', 'Promo', 'Standard & Co') THEN 'canonical_exact'
        WHEN n IN ('economy', 'promo', 'standard and co') THEN 'canonical_normalized' WHEN n = 'small' THEN 'override'
        WHEN contains(topic, '/') OR contains(n, ' and ') THEN 'combined_to_misc' ELSE 'unmapped_keep' END AS reason FROM normal),
done AS (SELECT *, CASE reason WHEN 'none' THEN NULL WHEN 'empty' THEN NULL WHEN 'dropped' THEN NULL WHEN 'canonical_exact' THEN topic
        WHEN 'canonical_normalized' THEN CASE n WHEN 'economy' THEN 'ECONOMY' WHEN 'promo' THEN 'Promo' ELSE 'Standard & Co' END
        WHEN 'override' THEN 'Standard & Co' WHEN 'combined_to_misc' THEN 'MISC' ELSE topic END AS mapped FROM mapped_)"""


@query(f"WITH {_LABELS} SELECT question_id, topic, mapped, reason FROM done")
def topic_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("question_id", "topic", "mapped", "reason")


@query(f"""WITH {_LABELS} SELECT generator, topic, count(*) AS n, max(mapped) AS mapped,
       CASE WHEN count(DISTINCT reason) > 1 THEN 'multiple' ELSE max(reason) END AS reason,
       array_to_string(list_sort(list(question_id))[1:3], ',') AS examples FROM done GROUP BY 1, 2""")
def topic_mapping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = T.mapping_report(_mapped(spark, sf_dir), "topic", "generator", examples=3)
    return report.withColumn("examples", F.array_join("examples", ","))


@query(f"""WITH {_LABELS}, c AS (SELECT generator, coalesce(mapped, 'unknown') AS topic, count(*) AS n FROM done GROUP BY 1, 2),
g AS (SELECT generator, topic FROM (SELECT DISTINCT generator FROM c), (SELECT DISTINCT topic FROM c))
SELECT generator, topic, coalesce(n, 0) AS n, (sum(coalesce(n, 0)) OVER (PARTITION BY generator))::BIGINT AS total,
       round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY generator), 6) AS share FROM g LEFT JOIN c USING (generator, topic)""")
def topic_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.distribution(_mapped(spark, sf_dir), "generator", "mapped")


@query(f"""WITH {_LABELS}, c AS (SELECT generator, mapped, count(*) AS n, min(question_id) AS f FROM done GROUP BY 1, 2)
SELECT generator, sum(n)::BIGINT AS num_questions, sum(CASE WHEN mapped IS NULL THEN n ELSE 0 END)::BIGINT AS num_unclassified,
       (SELECT mapped FROM c d WHERE d.generator = c.generator AND mapped IS NOT NULL ORDER BY n DESC, f LIMIT 1) AS majority_topic
FROM c GROUP BY 1""")
def topic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.summary(_mapped(spark, sf_dir), "mapped", "question_id", "generator")


@query(f"""WITH {_LABELS}, f AS (SELECT coalesce(mapped, 'unknown') AS mapped, min(question_id) AS f FROM done GROUP BY 1)
SELECT mapped, (row_number() OVER (ORDER BY mapped = 'unknown', f) - 1)::INT AS topic_ord FROM f""")
def topic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mapped(spark, sf_dir).withColumn("mapped", F.coalesce("mapped", F.lit("unknown")))
    return T.first_seen(rows, "mapped", "question_id")


@query(f"""WITH {_LABELS}, t AS (SELECT * FROM (VALUES ('ECONOMY', 300), ('Promo', 10), ('absent', 5), ('MISC', 0)) v(category, target)),
c AS (SELECT mapped AS category, count(*) AS n FROM done WHERE mapped IS NOT NULL GROUP BY 1)
SELECT category, coalesce(target, 0)::BIGINT AS target, coalesce(n, 0) AS current, greatest(coalesce(target, 0) - coalesce(n, 0), 0)::BIGINT AS remaining,
       CASE WHEN target IS NULL THEN 0 ELSE greatest(coalesce(n, 0) - target, 0) END::BIGINT AS overshoot,
       CASE WHEN target IS NULL THEN n ELSE 0 END::BIGINT AS extra FROM t FULL JOIN c USING (category)""")
def target_remainders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("ECONOMY", 300), ("Promo", 10), ("absent", 5), ("MISC", 0)]
    targets = spark.createDataFrame(rows, "category string, target long")
    current = _mapped(spark, sf_dir).where("mapped is not null").groupBy(F.col("mapped").alias("category")).agg(F.count("*").alias("n"))
    out = T.remainders(targets, current)
    return out.select("category", *(F.col(c).cast("long") for c in out.columns if c != "category"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(lower(left(source || ' & ' || lang, 40)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS label,
       upper(regexp_replace(source, '[^A-Za-z0-9._-]+', '_', 'g')) AS name, (n_chars % 5)::INT AS level, printf('%.1f%%', (doc_id % 97) / 97.0 * 100) AS pct
FROM documents""")
def label_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    joined = F.concat(F.col("source"), F.lit(" & "), F.col("lang"))
    return docs.select(
        "doc_id", X.normalize_label(F.substring(joined, 1, 40)).alias("label"), F.upper(X.safe_file_name(F.col("source"))).alias("name"),
        X.heat_level(F.col("n_chars") % 5, F.lit(0), F.lit(4)).alias("level"), X.percent((F.col("doc_id") % 97) / 97).alias("pct"),
    )


@query(r"""WITH r AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'The answer is (' || chr((65 + conv_id % 7)::INT) || ').'
        WHEN 1 THEN 'Answer: ' || chr((97 + conv_id % 7)::INT) WHEN 2 THEN 'so I pick x, then ' || chr((65 + conv_id % 7)::INT) ELSE 'none 42' END AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 AND conv_id % 7 < 5 THEN chr((65 + conv_id % 7)::INT) END AS letter FROM r""")
def answer_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, up, low = F.col("turn") % 4, F.char(65 + F.col("conv_id") % 7), F.char(97 + F.col("conv_id") % 7)
    response = (
        F.when(k == 0, F.concat(F.lit("The answer is ("), up, F.lit(")."))).when(k == 1, F.concat(F.lit("Answer: "), low))
        .when(k == 2, F.concat(F.lit("so I pick x, then "), up)).otherwise("none 42")
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.answer_letter(response).alias("letter"))


@query("""SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS n_keyed,
       max(json_extract_string(props, '$.k')) AS top FROM events GROUP BY 1""")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON text, pulled out and aggregated."""
    key = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(key).alias("n_keyed"), F.max(key).alias("top"))


_CANONICAL = {"small": "Standard & co", "large plated": "no such", "standard": "ECONOMY"}


@query("""WITH l AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN ' ' || lower(p_type) || '!' ELSE p_type END AS raw, p_type AS t FROM part)
SELECT k, CASE WHEN raw IS NOT NULL THEN CASE t WHEN 'ECONOMY' THEN 'ECONOMY' WHEN 'PROMO' THEN 'Promo' WHEN 'SMALL' THEN 'Standard & Co' WHEN 'STANDARD' THEN 'ECONOMY' END END AS topic,
    CASE WHEN raw IS NULL THEN 'no category: ' WHEN t = 'LARGE' THEN 'no category: no such' WHEN t NOT IN ('ECONOMY', 'PROMO', 'SMALL', 'STANDARD') THEN 'no category: ' || raw END AS error FROM l""")
def canonical_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of parts by name, else by an override's own category; one override leads nowhere."""
    over = _CANONICAL | {"large": "no such"}
    k = F.col("p_partkey")
    raw = F.when(k % 7 == 0, None).when(k % 2 == 0, F.concat(F.lit(" "), F.lower("p_type"), F.lit("!"))).otherwise(F.col("p_type"))
    found = table(spark, sf_dir, "part").select(k.alias("k"), T.canonical(raw, CATEGORIES, over).alias("c"))
    return found.select("k", "c.topic", "c.error")
