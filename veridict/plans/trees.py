"""Evaluation trees written out of the given tables, and read again.

Every query writes the files that it needs below the shared folder, with rows
and files that readers must pass over, and compares what the readers give with
the tables themselves.  A run is 5,000 order keys, so files stay small and
their number follows the tables.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.plans import query
from veridict.sources import json_tree as J
from veridict.sources.sinks import shim_reports, write_tree
from veridict.sources.tables import SQL_ANSWERS, SQL_LINES, SQL_RATINGS, answers, ratings, table

RUN_KEYS = 5000


def _folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="veridict-")
    return f"{shared.rstrip('/')}/tree-{uuid.uuid4().hex}"


def _stored(df: DataFrame) -> DataFrame:
    """What several readers need, written once."""
    where = _folder(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def _bars(reader: str, rows: DataFrame, *columns: str | Column) -> DataFrame:
    """Rows as texts: fields between bars, a dash for a missing one."""
    text = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-")) for c in columns]
    return rows.select(F.lit(reader).alias("reader"), F.concat_ws("|", *text).alias("item"))


def _sql_bars(reader: str, source: str, *columns: str) -> str:
    return f"SELECT '{reader}' AS reader, concat_ws('|', {', '.join(f"coalesce(({c})::VARCHAR, '-')" for c in columns)}) AS item FROM {source}"


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _run(unit: str = "unit") -> Column:
    k = F.floor(F.col(unit) / RUN_KEYS)
    return F.concat(F.lit("q"), k.cast("string"), F.lit("_seed"), (k + 3).cast("string"))


def _gen(name: str = "generator") -> Column:
    return F.concat(F.lit("g"), F.substring(name, 1, 1))


def _runs(df: DataFrame) -> DataFrame:
    """With generator and run as the tree names them."""
    return df.withColumns({"gen": _gen(), "run": _run(), "r": F.floor(F.col("unit") / RUN_KEYS)})


def _json(**fields: Column) -> Column:
    """An object as text; null fields stay, as null."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


def _files(rows: DataFrame, path: Column, item: Column, order: str, more: str = "") -> DataFrame:
    """One array a file: the items in order, and what ``more`` adds at the end (a run's files are small by its keys)."""
    listed = rows.select(path.alias("path"), F.struct(F.col(order).alias("o"), item.alias("item")).alias("e"))
    each = listed.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["item"]), ", ").alias("items"))
    return each.select("path", F.concat(F.lit("["), "items", F.lit(f"{more}]")).alias("value"))


_name = lambda c: F.regexp_extract(c, "([^/]*)/*$", 1)
_SQL_RUN = f"'q' || (unit // {RUN_KEYS}) || '_seed' || (unit // {RUN_KEYS} + 3)"
_SQL_TREE = f"SELECT *, 'g' || substr(generator, 1, 1) AS gen, {_SQL_RUN} AS run, unit // {RUN_KEYS} AS r"


@query(f"""WITH {SQL_RATINGS}, t AS ({_SQL_TREE} FROM ratings)
{_sql_bars("ratings", "t", "gen", "run", "'j' || judge", "unit", "verdict", "CASE WHEN unit % 6 <> 4 THEN score END", "output_valid")}""")
def tree_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge files of every run: verdicts and scores in all forms, an entry in each that is no object, and a file that is no JSON."""
    rated, k = _runs(ratings(spark, sf_dir)), F.col("unit") % 6
    score = F.col("score").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = F.when(k == 2, quoted(score)).when(k == 3, F.concat(score, F.lit(".7"))).when(k == 4, quoted(F.concat(score, F.lit(".0")))).otherwise(score)
    verdict = F.when(k == 1, F.concat(F.lit(" "), F.lower("verdict"), F.lit(" "))).when(k == 5, F.lit("MAYBE")).otherwise(F.col("verdict"))
    item = F.concat(
        F.lit('{"question_id": "'), F.col("unit").cast("string"), F.lit('", "judge_output_valid": '), F.col("output_valid").cast("string"),
        F.lit(', "judge_verdict": '), quoted(verdict), F.lit(', "judge_json": {"logical_validity": '), (F.col("verdict") == "PASS").cast("string"),
        F.lit('}, "judge_medical_accuracy_score": '), number, F.lit("}"),
    )
    folder = F.concat_ws("/", "gen", "run")
    path = F.concat(folder, F.lit("/j"), F.col("judge").cast("string"), F.lit("_judge_result.json"))
    broken = rated.select(F.concat(folder, F.lit("/bad_judge_result.json")).alias("path"), F.lit("{not json").alias("value")).distinct()
    root = _folder(spark)
    write_tree(_files(rated, path, item, "unit", ', 7, "text", null').unionByName(broken), root)
    return _bars("ratings", J.read_ratings(spark, root), "generator", _name("run_id"), "judge", "unit", "verdict", "score", "output_valid")


_TOPIC = "CASE unit % 3 WHEN 0 THEN 't' || unit % 4 WHEN 1 THEN 'u' || unit % 4 END"


@query(f"""WITH {SQL_LINES}, {SQL_ANSWERS}, t AS ({_SQL_TREE}, CASE WHEN unit % 10 = 0 THEN '' ELSE unit::VARCHAR END AS id, {_TOPIC} AS topic FROM answers)
{_sql_bars("answers", "t", "gen", "model", "id", "gold", "pred", "topic")}
UNION ALL {_sql_bars("items", "t WHERE id <> ''", "model", "run", "id", "coalesce(pred = gold, false)::INT")}""")
def tree_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer files of every run beside a judge file, with topics under two names and ids that are empty."""
    given = _runs(answers(spark, sf_dir))
    unit, k = F.col("unit").cast("string"), F.col("unit") % 3
    item = _json(
        quiz_id=F.col("run"), question_id=F.when(F.col("unit") % 10 == 0, "").otherwise(unit), answer=F.col("gold"), pred=F.col("pred"),
        target_topic=F.when(k == 0, F.concat(F.lit("t"), (F.col("unit") % 4).cast("string"))),
        topic=F.when(k == 1, F.concat(F.lit("u"), (F.col("unit") % 4).cast("string"))),
    )
    folder = F.concat_ws("/", "gen", "run")
    judged = given.select(F.concat(folder, F.lit("/m1_judge_result.json")).alias("path"), F.lit('[{"question_id": "x"}]').alias("value")).distinct()
    root = _folder(spark)
    write_tree(_files(given, F.concat(folder, F.lit("/"), "model", F.lit("_result.json")), item, "unit").unionByName(judged), root)
    found = J.read_answers(spark, root)
    return _bars("answers", found, "generator", "model", "unit", "gold", "pred", "topic").unionByName(
        _bars("items", J.item_level(found), "model", "quiz_id", "question_id", "correct")
    )


_SQL_SUMMARIES = f"""{SQL_LINES}, {SQL_ANSWERS}, t AS ({_SQL_TREE} FROM answers),
m AS (SELECT gen, run, r, model, count(*) FILTER (pred = gold) AS c, count(*) AS n, round(10000 * (count(*) FILTER (pred = gold) / count(*)::DOUBLE + (model = 'm3')::INT * 0.1)) AS acc
    FROM t GROUP BY 1, 2, 3, 4),
s AS (SELECT * FROM m WHERE NOT (model = 'm7' AND r % 2 = 1)), j AS (SELECT gen, run, r, max(n) AS n, min(model) AS model FROM m GROUP BY 1, 2, 3)"""


@query(f"""WITH {_SQL_SUMMARIES}
{_sql_bars("summaries", "s", "gen", "run", "model", "c", "n - c", "n", "acc::BIGINT")}
UNION ALL {_sql_bars("consistent", "s WHERE model <> 'm3'", "gen", "run", "model")}
UNION ALL {_sql_bars("partial", "m WHERE model = 'm7' AND r % 2 = 1", "gen", "run", "model", "'no_summary'")}
UNION ALL {_sql_bars("partial", "s WHERE model = 'm5' AND gen = 'g2'", "gen", "run", "model", "'no_result'")}
UNION ALL {_sql_bars("missing", "(SELECT DISTINCT run FROM m WHERE model = 'm7') q WHERE run NOT IN (SELECT run FROM s WHERE model = 'm7')", "run")}
UNION ALL {_sql_bars("judges", "j WHERE gen = 'g1'", "gen", "run", "'j1'", "n", "'C'", "r")}
UNION ALL {_sql_bars("judges", "j, (VALUES ('jy', 0), ('jz', 2)) v(name, more) WHERE gen <> 'g1'", "gen", "run", "name", "n + more", "NULL", "NULL")}
UNION ALL {_sql_bars("sizes", "j", "gen", "run", "CASE WHEN r % 2 = 0 THEN n + 1 ELSE n + 2 END")}
UNION ALL {_sql_bars("runs", "j", "gen", "run")}
UNION ALL {_sql_bars("runs_of_q1", "j WHERE run LIKE 'q1%'", "gen", "run")}
UNION ALL {_sql_bars("runs_with_manifest", "j WHERE r % 2 = 0", "gen", "run")}""")
def tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of takers and judges, manifests and sizes of runs, what is missing and what is left half-done."""
    given = _runs(answers(spark, sf_dir))
    right = F.count_if(F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)))
    own = _stored(given.groupBy("gen", "run", "r", "model").agg(right.alias("c"), F.count("*").alias("n")))
    per = own.groupBy("gen", "run", "r").agg(F.max("n").alias("n"))
    folder = F.concat_ws("/", "gen", "run")
    file = lambda df, name, value: df.select(F.concat(folder, F.lit("/"), name).alias("path"), value.alias("value"))
    acc = F.col("c") / F.col("n") + F.when(F.col("model") == "m3", 0.1).otherwise(0.0)
    summary = _json(model=F.col("model"), total_corr=F.col("c"), total_wrong=F.col("n") - F.col("c"), acc=acc, n_items=F.col("n"))
    judge = lambda name, n, **more: _json(model=F.lit(name), quiz_id=F.col("run"), n_items=n, **more)
    both = F.concat(F.lit("["), judge("jy", F.col("n")), F.lit(", 1, "), judge("jz", F.col("n") + 2), F.lit("]"))
    counts = F.create_map(F.lit("C"), F.col("r"))
    root = _folder(spark)
    write_tree(_union(
        file(own.where("not (model = 'm7' and r % 2 = 1)"), F.concat("model", F.lit("_summary.json")), summary),
        file(own.where("not (model = 'm5' and gen = 'g2')"), F.concat("model", F.lit("_result.json")), F.concat(F.lit("["), _json(quiz_id=F.col("run"), question_id=F.lit("x")), F.lit("]"))),
        file(per.where("r % 2 = 0"), F.lit("manifest.json"), _json(n_items=F.col("n") + 1)),
        file(per.where("gen = 'g1'"), F.lit("j1_judge_summary.json"), judge("j1", F.col("n"), fail_reason_counts=counts)),
        file(per, F.lit("summary_all_judges.json"), both),
    ), root)
    tree = _stored(J.scan(spark, root))  # the files outnumber all that is in them, so each is opened once
    summaries, results = J.read_answer_summaries(spark, tree).where("total_corr is not null"), J.read_answers(spark, tree)
    judges = J.read_judge_summaries(spark, tree)
    gen = lambda c: F.regexp_extract(c, "([^/]*)/[^/]*/*$", 1)
    wanted = own.where("model = 'm7'").groupBy(F.col("run").alias("quiz_id")).agg(F.lit(None).cast("long").alias("n_items"))
    dirs = lambda *a, **k: J.run_dirs(spark, tree, *a, **k)
    return _union(
        _bars("summaries", summaries, "generator", "run", "model", "total_corr", "total_wrong", "n_items", F.round(F.col("acc") * 10000).cast("long")),
        _bars("consistent", J.consistent_summaries(summaries), "generator", "run", "model"),
        _bars("partial", J.partial_runs(results, summaries), gen("run_dir"), _name("run_dir"), "model", "state"),
        _bars("missing", J.missing_work(wanted, summaries, "m7"), "quiz_id"),
        _bars("judges", judges, "generator", "run", "model", "n_items", F.map_keys("fail_reason_counts")[0], F.map_values("fail_reason_counts")[0]),
        _bars("sizes", J.run_sizes(spark, tree), gen("run_dir"), _name("run_dir"), "n_items"),
        _bars("runs", dirs(), gen("run_dir"), "run"), _bars("runs_of_q1", dirs("q1*"), gen("run_dir"), "run"),
        _bars("runs_with_manifest", dirs(artifacts=("manifest.json",), containing="seed"), gen("run_dir"), "run"),
    )


#: Quizzes of orders: a quiz is 100 order keys, listed by the manifest of its priority, and by a newer one of another generator if k % 3 = 0.
_SQL_QUIZZES = """q AS (SELECT 'g' || substr(o_orderpriority, 1, 1) AS gen, o_orderkey // 100 AS k, count(*) AS n, min(o_custkey) AS seed FROM orders GROUP BY 1, 2),
l AS (SELECT gen, k, gen || '_' || k || CASE WHEN k % 2 = 0 THEN '_seed' || k ELSE '' END AS quiz, seed, n FROM q),
e AS (SELECT gen AS folder, 'quizbench_manifest_a.json' AS file, 1 AS age, quiz, k, gen || 'x' AS generator, CASE WHEN k % 5 = 0 THEN seed WHEN k % 2 = 0 THEN k END AS seed, CASE WHEN k % 7 = 0 THEN 'p' || k END AS path FROM l
    UNION ALL SELECT gen, 'quizbench_manifest.json', 2, quiz, k, CASE WHEN k % 6 = 0 THEN 'other' ELSE gen || 'x' END, CASE WHEN k % 2 = 0 THEN k END, 'r' || k FROM l WHERE k % 3 = 0)"""


@query(f"""WITH {_SQL_QUIZZES}, f AS (SELECT *, row_number() OVER (PARTITION BY quiz ORDER BY (path IS NOT NULL)::INT + 1 + (seed IS NOT NULL)::INT DESC, file) AS rank FROM e)
{_sql_bars("listed", "e", "folder", "file", "quiz", "generator", "seed", "path")}
UNION ALL {_sql_bars("first", "(SELECT quiz, min_by(generator, file) AS generator, count(DISTINCT generator) > 1 AS conflict FROM e GROUP BY 1)", "quiz", "generator", "conflict")}
UNION ALL {_sql_bars("last", "(SELECT quiz, max_by(generator, age) AS generator, count(DISTINCT generator) > 1 AS conflict FROM e GROUP BY 1)", "quiz", "generator", "conflict")}
UNION ALL {_sql_bars("newest", "e WHERE age = 2", "quiz", "generator")}
UNION ALL {_sql_bars("merged", "(SELECT quiz, min_by(path, rank) FILTER (path IS NOT NULL) AS path, min_by(generator, rank) AS generator, min_by(seed, rank) FILTER (seed IS NOT NULL) AS seed FROM f GROUP BY 1)", "quiz", "path", "generator", "seed")}
UNION ALL {_sql_bars("legacy", "e WHERE age = 2", "quiz")}""")
def tree_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two manifests for each generator: quizzes with gaps, generators that they disagree about, the newer one of the legacy name."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("generator"), F.floor(F.col("o_orderkey") / 100).alias("k"), "o_custkey")
    quizzes = orders.groupBy(_gen().alias("gen"), "k").agg(F.min("o_custkey").alias("seed"))
    k = F.col("k")
    text = lambda c: c.cast("string")
    quiz = F.concat("gen", F.lit("_"), text(k), F.when(k % 2 == 0, F.concat(F.lit("_seed"), text(k))).otherwise(""))
    listed = lambda rows, item: rows.groupBy("gen").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", item.alias("item")))), lambda e: e["item"]), ",").alias("items"))
    one = _json(quiz_id=quiz, seed=F.when(k % 5 == 0, F.col("seed")), quiz_path=F.when(k % 7 == 0, F.concat(F.lit("p"), text(k))))
    two = _json(quiz_id=quiz, generator_model=F.when(k % 6 == 0, F.lit("other")), quiz_path=F.concat(F.lit("r"), text(k)))
    made = lambda rows, file, at: rows.select(
        F.concat("gen", F.lit(f"/{file}")).alias("path"),
        F.concat(F.lit('{"generator_model": "'), "gen", F.lit('x", "quizzes": ['), "items", F.lit("]}")).alias("value"), F.lit(at).alias("modified"),
    )
    root = _folder(spark)
    old = made(listed(quizzes, one), "quizbench_manifest_a.json", 1_700_000_000_000)
    write_tree(old.unionByName(made(listed(quizzes.where(k % 3 == 0), two), "quizbench_manifest.json", 1_700_000_100_000)), root)
    found = J.read_manifest_quizzes(spark, root)
    return _union(
        _bars("listed", found, F.regexp_extract("file_path", "([^/]*)/[^/]*$", 1), "file_name", "quiz_id", "generator", "seed", "quiz_path"),
        _bars("first", J.quiz_generators(found), "quiz_id", "generator", "conflict"), _bars("last", J.quiz_generators(found, True), "quiz_id", "generator", "conflict"),
        _bars("newest", J.generators_of_newest(found), "quiz_id", "generator"), _bars("merged", J.merge_manifests(found), "quiz_id", "quiz_path", "generator", "seed"),
        _bars("legacy", J.legacy_manifests(found, root), "quiz_id"),
    )


#: Topics files of a run: by r % 4 one mapped and one raw, two raw ones, one of another evaluator, one mapped.
_SQL_TOPICS = f"""{SQL_RATINGS}, u AS (SELECT DISTINCT generator, unit FROM ratings), t AS ({_SQL_TREE} FROM u),
f AS (SELECT t.*, file, model, mapped FROM t JOIN (VALUES (0, 'topics_ev.json', 'ev', false), (0, 'topics_ev_mapped.json', 'ev', true), (1, 'topics_a.json', 'ev', false), (1, 'topics_b.json', 'ev', false),
    (2, 'topics_c.json', 'ex', false), (3, 'topics_z_mapped.json', 'ev', true)) v(k, file, model, mapped) ON r % 4 = k),
l AS (SELECT *, row_number() OVER (PARTITION BY gen, run, file ORDER BY unit) AS pos, CASE WHEN unit % 5 = 0 THEN 'unknown' ELSE 'Topic  ' || unit % 3 END AS topic,
    CASE WHEN mapped THEN 'Mapped ' || unit % 2 END AS topic_mapped FROM f),
i AS (SELECT *, CASE WHEN unit % 11 = 0 THEN run || '-' || CASE WHEN pos < 1000 THEN lpad(pos::VARCHAR, 3, '0') ELSE pos::VARCHAR END ELSE unit::VARCHAR END AS id FROM l)"""


@query(f"""WITH {_SQL_TOPICS}, r AS (SELECT DISTINCT gen, run, r % 4 AS k FROM t)
{_sql_bars("topics", "i", "gen", "run", "file", "id", "topic", "topic_mapped")}
UNION ALL {_sql_bars("of_g1", "i WHERE gen = 'g1' AND model = 'ex'", "gen", "run", "id")}
UNION ALL {_sql_bars("misses", "r JOIN (VALUES (0, 'topics_ev_mapped.json'), (1, 'topics_b.json'), (2, 'topics_c.json'), (3, 'topics_z_mapped.json')) v(k, f) USING (k)", "gen", "run", "f")}
UNION ALL {_sql_bars("subset", "r JOIN (VALUES (0, 'topics_ev_mapped.json'), (3, 'topics_z_mapped.json')) v(k, f) USING (k)", "gen", "run", "f")}
UNION ALL {_sql_bars("planner", "r JOIN (VALUES (0, 'topics_ev_mapped.json', NULL), (1, NULL, 'several unmapped topics files'), (2, NULL, 'no topics file of the evaluator'), (3, 'topics_z_mapped.json', NULL)) v(k, f, e) USING (k)", "gen", "run", "f", "e")}
UNION ALL {_sql_bars("accumulate", "r JOIN (VALUES (0, 'topics_ev_mapped.json', NULL), (1, NULL, 'several topics files'), (2, NULL, 'no topics file of the evaluator'), (3, 'topics_z_mapped.json', NULL)) v(k, f, e) USING (k)", "gen", "run", "f", "e")}
UNION ALL {_sql_bars("labels", "i WHERE file IN ('topics_ev_mapped.json', 'topics_b.json', 'topics_c.json', 'topics_z_mapped.json')", "gen", "run", "id", "lower(regexp_replace(coalesce(topic_mapped, topic), '\\s+', ' ', 'g'))")}""")
def tree_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics files of every run by all policies of choice, with labels that are missing and ids made from places."""
    units = _runs(ratings(spark, sf_dir).select("generator", "unit").distinct())
    kinds = [(0, "topics_ev.json", "ev", False), (0, "topics_ev_mapped.json", "ev", True), (1, "topics_a.json", "ev", False), (1, "topics_b.json", "ev", False),
             (2, "topics_c.json", "ex", False), (3, "topics_z_mapped.json", "ev", True)]
    listed = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(f).alias("file"), F.lit(m).alias("model"), F.lit(mapped).alias("mapped")) for k, f, m, mapped in kinds))
    each = units.select("*", F.explode(F.filter(listed, lambda e: e["k"] == F.col("r") % 4)).alias("e")).select("*", "e.*")
    unit = F.col("unit")
    label = lambda n: (unit % n).cast("string")
    item = _json(
        question_id=F.when(unit % 11 != 0, unit.cast("string")), topic=F.when(unit % 5 != 0, F.concat(F.lit("Topic  "), label(3))),
        topic_mapped=F.when(F.col("mapped"), F.concat(F.lit("Mapped "), label(2))),
    )
    path = F.concat_ws("/", "gen", "run", "file")
    files = _files(each, F.concat_ws("|", path, "run", "model", F.col("mapped").cast("string")), item, "unit")
    part = lambda k: F.split("path", r"\|")[k]
    head = F.concat(F.lit('{"quiz_id": "'), part(1), F.lit('", "eval_model": "'), part(2), F.lit('", '), F.when(part(3) == "true", F.lit('"topic_mapping": {"applied_at": "2026"}, ')).otherwise(""))
    root = _folder(spark)
    write_tree(files.select(part(0).alias("path"), F.concat(head, F.lit('"per_question": '), "value", F.lit("}")).alias("value"), F.lit(1_700_000_000_000).alias("modified")), root)
    topics = J.read_topics(spark, root)
    chosen = lambda policy: J.choose_topics(topics, "ev", policy)
    gen = F.regexp_extract("run_dir", "([^/]*)/[^/]*$", 1)
    once = lambda df, *c: df.select(gen.alias("gen"), _name("run_dir").alias("name"), *c).distinct()
    return _union(
        _bars("topics", topics, "generator", "run", "file_name", "question_id", "topic", "topic_mapped"),
        _bars("of_g1", J.read_topics(spark, root, ("g1",), ("ex",)), "generator", "run", "question_id"),
        *(_bars(p, once(chosen(p), "file_name"), "gen", "name", "file_name") for p in ("misses", "subset")),
        *(_bars(p, once(chosen(p), "file_name", "error"), "gen", "name", "file_name", "error") for p in ("planner", "accumulate")),
        _bars("labels", J.question_topics(chosen("misses")), gen, _name("run_dir"), "question_id", "topic"),
    )


_BRAND = "'b' || substr(p_brand, 7)"
_SQL_PARTS = f"p AS (SELECT p_partkey AS k, {_BRAND} AS b, p_type AS t, p_size AS s, p_retailprice AS price, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), F.concat(F.lit("b"), F.substring("p_brand", 7, 9)).alias("b"), F.col("p_type").alias("t"), F.col("p_size").alias("s"), F.col("p_retailprice").alias("price")
    )


def _text(rows: DataFrame, path: Column, order: str, line: Column, separator: str = "\n") -> DataFrame:
    """One text a path: lines in order (a brand's or a report's, which are few)."""
    each = rows.groupBy(path.alias("path")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("ls"))
    return each.select("path", F.array_join(F.transform("ls", lambda e: e["line"]), separator).alias("value"))


@query(f"""WITH {_SQL_PARTS}, o AS (SELECT o_orderkey AS k FROM orders)
{_sql_bars("items", "p", "b", "k", "CASE WHEN s % 3 <> 0 THEN t END")}
UNION ALL {_sql_bars("lines", "(SELECT b, count(*) AS n FROM p GROUP BY 1)", "b || '.jsonl'", "n")}
UNION ALL {_sql_bars("targets", "p", "b || '.jsonl'", "pos - 1", "CASE WHEN s % 3 <> 0 THEN t END")}
UNION ALL {_sql_bars("stems", "(SELECT DISTINCT b FROM p)", "b", "b || '.jsonl'")}
UNION ALL {_sql_bars("selected", "p WHERE s > 40", "'x'", "b", "'ja'", "k", "t", "'s' || k")}
UNION ALL {_sql_bars("results", "(SELECT DISTINCT b, s, max(k) AS k FROM p WHERE s % 5 <> 0 GROUP BY ALL)", "b", "'m' || s", "s", "k")}
UNION ALL {_sql_bars("batch", "o", "k", "CASE WHEN k % 7 = 0 THEN 'err' ELSE 'out' END")}""")
def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quizzes as JSON lines, selection reports, given results, and batch outputs that errors override."""
    part, k = _parts(spark, sf_dir), F.col("k")
    text = lambda c: F.col(c).cast("string")
    item = F.to_json(F.struct(F.col("b").alias("quiz_id"), text("k").alias("question_id"), F.when(F.col("s") % 3 != 0, F.col("t")).alias("target_topic")))
    chosen = F.to_json(F.struct(k.alias("index"), F.col("t").alias("abms_specialty"), F.concat(F.lit("s"), text("k")).alias("source_question_id")))
    report = _text(part.where("s > 40"), F.col("b"), "k", chosen, ", ")
    value = F.concat(F.lit('{"subset_tag": "x", "generator_model": "'), "path", F.lit('", "judge_models": ["ja"], "selected": ['), "value", F.lit("]}"))
    result = part.groupBy("b", "s").agg(F.max("k").alias("k"))
    accuracy = F.when(F.col("s") % 5 == 0, F.lit("none")).otherwise(text("s"))
    given = F.to_json(F.struct(F.col("b").alias("quiz_generator"), F.concat(F.lit("m"), text("s")).alias("model"), accuracy.alias("accuracy"), k.alias("n_items")))
    results = _text(result, F.concat(F.lit("extra/"), "b", F.lit(".json")), "s", given, ", ")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_orderkey") / RUN_KEYS).cast("string").alias("r"))
    line = lambda v: F.to_json(F.struct(text("k").alias("custom_id"), F.lit(v).alias("v")))
    batch = lambda v, rows: _text(rows, F.concat(F.lit(f"{v}/"), "r", F.lit(".jsonl")), "k", line(v))
    root = _folder(spark)
    write_tree(_union(
        _text(part, F.concat(F.lit("quizzes/"), "b", F.lit(".jsonl")), "k", item, "\n\n"),
        report.select(F.concat(F.lit("selection/"), "path", F.lit("/selection_report_x.json")).alias("path"), value.alias("value")),
        results.select("path", F.concat(F.lit('{"results": ['), "value", F.lit("]}")).alias("value")),
        batch("out", orders), batch("err", orders.where("k % 7 = 0")),
    ), root)
    files = spark.read.text(f"{root}/quizzes").select("_metadata.file_path", F.col("_metadata.file_modification_time").alias("modified")).distinct()
    lines = J.batch_lines(spark.read.text(f"{root}/out"), spark.read.text(f"{root}/err"))
    return _union(
        _bars("items", J.read_quiz_items(spark, f"{root}/quizzes"), "quiz_id", "question_id", "target_topic"),
        _bars("lines", J.count_quiz_lines(spark, f"{root}/quizzes"), _name("file_path"), "n"),
        _bars("targets", J.target_topics(spark, f"{root}/quizzes"), _name("file_path"), "line", "target_topic"),
        _bars("stems", J.newest_by_stem(files), "stem", _name("file_path")),
        _bars("selected", J.read_selection(spark, f"{root}/selection"), "subset_tag", "generator_model", F.col("judge_models")[0], "index", "abms_specialty", "source_question_id"),
        _bars("results", J.read_extra_results(spark, f"{root}/extra"), "generator", "model", F.col("acc").cast("long"), "n_items"),
        _bars("batch", lines, "custom_id", F.get_json_object("line", "$.v")),
    )


_SQL_TABLES = f"""{_SQL_PARTS}, c AS (SELECT b, count(*) AS n, max(s) AS top, sum(s) AS total FROM p GROUP BY 1),
y AS (SELECT t, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, t) - 1) AS ord FROM p GROUP BY 1)"""


@query(f"""WITH {_SQL_TABLES}
{_sql_bars("targets", "y", "t", "n", "ord")}
UNION ALL {_sql_bars("cost", "c", "b", "2 * top")}
UNION ALL {_sql_bars("accuracy", "c WHERE n % 4 <> 1", "b", "n", "CASE WHEN n % 4 <> 2 THEN top END", "total")}
UNION ALL {_sql_bars("validity", "c", "b", "CASE n % 3 WHEN 0 THEN 25 + top % 3 WHEN 1 THEN 50 END")}
UNION ALL {_sql_bars("log", "c", "b || ' x'", "top", "total")}""")
def tree_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short tables as CSV with repeated, missing and unusable entries, and the counts in a log."""
    part = _parts(spark, sf_dir)
    brands = part.groupBy("b").agg(F.count("*").alias("n"), F.max("s").alias("top"), F.sum("s").alias("total"))
    types = part.groupBy("t").agg(F.count("*").alias("n")).withColumn("o", F.struct(-F.col("n"), "t"))
    text = lambda c: F.col(c).cast("string")
    csv = lambda name, rows, order, header, line: _text(rows, F.lit(name), order, line).select("path", F.concat(F.lit(header + "\n"), "value", F.lit("\n")).alias("value"))
    top2 = (2 * F.col("top")).cast("string")
    cost = F.concat("b", F.lit(",1\n"), "b", F.lit(","), top2, F.lit("\n"), "b", F.lit(",x"))
    sem = F.when(F.col("n") % 4 == 2, "").otherwise(text("top"))
    mean = F.when(F.col("n") % 4 == 1, "none").otherwise(text("n"))
    share = F.when(F.col("n") % 3 == 0, (25 + F.col("top") % 3).cast("string")).when(F.col("n") % 3 == 1, "0.5").otherwise("")
    counted = F.concat(F.lit(" "), "b", F.lit(" x: valid="), text("top"), F.lit(" / total="), text("total"), F.lit(" (1%)"))
    log = csv("log.txt", brands, "b", "[INFO] other\n g z: valid=9 / total=9 (1%)\n\n[INFO] Questions passing judge filters (tagged manifests: T)", counted)
    root = _folder(spark)
    write_tree(_union(
        csv("targets.csv", types, "o", "\ufeffNumber,Specialty", F.concat(text("n"), F.lit(","), "t")), csv("cost.csv", brands, "b", "\ufeffmodel,cost_per_quiz", cost),
        csv("accuracy.csv", brands, "b", "model,mean_accuracy,sem_accuracy,n", F.concat_ws(",", "b", mean, sem, text("total"))),
        csv("validity.csv", brands, "b", "model,questions_passing_percent", F.concat_ws(",", "b", share)),
        log.select("path", F.concat("value", F.lit(" TOTAL: valid=1 / total=4 (25%)\n\n g y: valid=1 / total=4 (25%)\n")).alias("value")),
    ), root)
    whole = lambda c, times=1: F.round(F.col(c) * times).cast("long")
    return _union(
        _bars("targets", J.read_targets(spark, f"{root}/targets.csv"), "category", "target", "ord"), _bars("cost", J.read_cost(spark, f"{root}/cost.csv"), "model", whole("cost")),
        _bars("accuracy", J.read_accuracy(spark, f"{root}/accuracy.csv"), "model", whole("mean_acc"), whole("sem"), "n_quizzes"),
        _bars("validity", J.read_validity(spark, f"{root}/validity.csv"), "model", whole("validity", 100)),
        _bars("log", J.validity_from_log(spark, f"{root}/log.txt", "T"), "generator", "n_valid", "n_total"),
    )


@query(f"""WITH {_SQL_TABLES}
{_sql_bars("counts", "c", "b", "top", "total", "total - top", "round(10000 * top / total::DOUBLE)::BIGINT")}
UNION ALL {_sql_bars("shims", "c", "b", "'runs/' || b", "'targets.csv'", "'/elsewhere/map.json'", "'auto'", "''", "'runs'")}""")
def tree_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of valid questions under other column names, and short reports by generator that stand for the whole one."""
    brands = _parts(spark, sf_dir).groupBy("b").agg(F.max("s").alias("top"), F.sum("s").alias("total"))
    root = _folder(spark)
    line = F.concat(F.lit(" "), "b", F.lit(" ,"), F.col("top").cast("string"), F.lit(","), F.col("total").cast("string"))
    text = _text(brands, F.lit("counts.csv"), "b", line)
    counts = text.select("path", F.concat(F.lit("\ufeffGenerator_Model,Valid,TOTAL\n_EXAMPLE,x,\n"), "value", F.lit("\n")).alias("value"))
    report = {"created_at": "2026", "targets_csv": "/base/targets.csv", "topic_map_path": "/elsewhere/map.json", "mode": "auto", "runs_root": "/base/runs"}
    generators = brands.select(F.col("b").alias("generator"), F.concat(F.lit("/base/runs/"), "b").alias("runs_root"))
    write_tree(counts.unionByName(shim_reports(generators, report, "report.json", "/base")), root)
    schema = "generator_model string, runs_root string, targets_csv string, topic_map_path string, mode string, unmapped_policy string, global_runs_root string"
    shims = J.read_tree(spark, root, "topic_mapping_report.json", schema)
    return _bars("counts", J.read_counts(spark, f"{root}/counts.csv"), "generator", "n_valid", "n_total", "n_invalid", F.round(F.col("rate") * 10000).cast("long")).unionByName(
        _bars("shims", shims, "generator_model", "runs_root", "targets_csv", "topic_map_path", "mode", "unmapped_policy", "global_runs_root")
    )
