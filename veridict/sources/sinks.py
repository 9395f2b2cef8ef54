"""Writers of tables, JSON lines and subsets."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists", one_file: bool = False) -> None:
    """A report with a header and a fixed column order; ``one_file`` (through one task) is for short ones."""
    chosen = df.select(*columns)
    (chosen.coalesce(1) if one_file else chosen).write.mode(mode).option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_by_key(df: DataFrame, path: str, *keys: str, overwrite: bool = False) -> None:
    """A folder of JSON lines for each key; rows are dealt by key first, so a key is few files."""
    df.repartition(*keys).write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*keys).json(path)


def selection_report(selected: DataFrame, subset_tag: str) -> DataFrame:
    """One report for each generator: targets met by category and the selected questions in order.

    A subset is small by its quotas; its rows are gathered into one array.
    """
    row = F.struct("index", "category", "question_id")
    per = selected.groupBy("generator").agg(F.sort_array(F.collect_list(row)).alias("selected"))
    counts = selected.groupBy("generator", "category").agg(F.count("*").alias("n"))
    targets = counts.groupBy("generator").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("targets_by_specialty"))
    return per.join(targets, "generator").select(F.lit(subset_tag).alias("subset_tag"), F.col("generator").alias("generator_model"), "targets_by_specialty", "selected")


def shim_reports(generators: DataFrame, report: dict, source: str, base: str | None = None, name: str = "topic_mapping_report.json") -> DataFrame:
    """path and value, for ``write_tree``: a short report for each generator that stands for the one of all generators.

    ``generators`` has generator and runs_root.  Paths below ``base`` become
    relative to it; what the whole report does not say is empty.
    """
    def relative(path: str | None) -> str:
        text = str(path or "")
        return text[len(base.rstrip("/")) + 1 :] if base and text.startswith(base.rstrip("/") + "/") else text

    prefix = f"{base.rstrip('/')}/" if base else ""
    root = F.when(F.startswith("runs_root", F.lit(prefix)), F.substring("runs_root", len(prefix) + 1, 1 << 20)).otherwise(F.col("runs_root"))
    fields = {"created_at": F.lit(str(report.get("created_at") or "")), "source_report_path": F.lit(source), "generator_model": F.col("generator"), "runs_root": root}
    fields |= {k: F.lit(relative(report.get(k))) for k in ("targets_csv", "topic_map_path")} | {k: F.lit(str(report.get(k) or "")) for k in ("mode", "unmapped_policy")}
    fields["global_runs_root"] = F.lit(relative(report.get("runs_root")))
    return generators.select(F.concat("generator", F.lit(f"/{name}")).alias("path"), F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("value"))


def batch_requests(items: DataFrame, model: str, prompt: str = "prompt") -> DataFrame:
    """Request lines of a batch job: one JSON text for each item, with its custom id."""
    body = F.struct(F.lit(model).alias("model"), F.col(prompt).alias("input"))
    return items.select(F.to_json(F.struct(F.col("custom_id"), F.lit("POST").alias("method"), body.alias("body"))).alias("value"))


#: Tasks that write a tree, for each core: many small files a task would make a late one last.
WRITERS_A_CORE = 4


def _placed(files: DataFrame, root: str) -> None:
    """Tasks write every text under its own name, in a folder that the machines share by its path."""
    named = files.select("path", "value", (F.col("modified") if "modified" in files.columns else F.lit(None)).cast("long").alias("modified"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        for batch in batches:
            for path, value, modified in zip(*(batch.column(c).to_pylist() for c in ("path", "value", "modified")), strict=True):
                to = os.path.join(root, path)
                if (folder := os.path.dirname(to)) not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                held = f"{folder}/.{uuid.uuid4().hex}"  # a task that is run again replaces what it wrote before
                with open(held, "w", encoding="utf-8", newline="") as out:
                    out.write((value or "") + "\n")
                if modified is not None:
                    os.utime(held, (modified / 1000, modified / 1000))
                os.replace(held, to)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    tasks = WRITERS_A_CORE * files.sparkSession.sparkContext.defaultParallelism
    named.repartition(tasks, "path").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def write_tree(files: DataFrame, root: str) -> None:
    """A file for each row: ``root``/``path`` with the text ``value``; with a column ``modified`` (ms), its time of change.

    Tasks write the texts.  On other file systems than shared folders the
    driver gives the files their names, of which it sees no more than that.
    Paths must differ.
    """
    spark = files.sparkSession
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda path: jvm.org.apache.hadoop.fs.Path(path)
    if at(root).getFileSystem(hadoop).getUri().getScheme() == "file":
        _placed(files, at(root).toUri().getPath())
        return
    held = f"{root.rstrip('/')}-{uuid.uuid4().hex}"
    time = F.col("modified").cast("string") if "modified" in files.columns else F.lit("")
    named = files.select(F.hex(F.concat_ws("|", time, "path").cast("binary")).alias("place"), "value")
    named.repartition("place").write.partitionBy("place").text(held)
    fs = at(held).getFileSystem(hadoop)
    for found in fs.globStatus(at(f"{held}/place=*/part-*")):
        place = found.getPath().getParent().getName().partition("=")[2]
        when, _, path = bytes.fromhex(place).decode().partition("|")
        to = at(f"{root.rstrip('/')}/{path}")
        fs.mkdirs(to.getParent())
        if not fs.rename(found.getPath(), to):
            raise OSError(f"{path} could not be put below {root}")
        if when:
            fs.setTimes(to, int(when), -1)
    fs.delete(at(held), True)


def write_versions(df: DataFrame, path: str, version: str, *keys: str, dry_run: bool = False) -> DataFrame:
    """Rewritten files of a run beside the old ones, below ``path/version``: an old version is never changed.

    Returns the number of rows by key; with ``dry_run`` nothing is written.
    """
    if not dry_run:
        write_by_key(df, f"{path.rstrip('/')}/{version}", *keys)
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def write_missing(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append only keys that ``path`` doesn't hold yet, as JSON lines; returns the keys written."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        df = df.join(spark.read.schema(df.schema).json(path).select(key).distinct(), key, "left_anti").select(*df.columns)
    written = df.select(key).distinct().collect()  # keys of reports: generators or runs
    df.write.mode("append").json(path)
    return spark.createDataFrame([(r[0],) for r in written], f"`{key}` string")


def chunk_manifest(chunked: DataFrame) -> DataFrame:
    """generator, chunk, n_items and the first and last id of every chunk of a subset."""
    return chunked.groupBy("generator", "chunk").agg(
        F.count("*").alias("n_items"), F.min_by("chunk_id", "index").alias("first_id"), F.max_by("chunk_id", "index").alias("last_id")
    )


def write_subset(selected: DataFrame, path: str, subset_tag: str) -> None:
    """The report, the questions by chunk and the manifest of a subset, each a folder of JSON lines below ``path``."""
    selection_report(selected, subset_tag).write.json(f"{path}/report")
    write_by_key(selected, f"{path}/quizzes", "generator", "chunk")
    chunk_manifest(selected).write.json(f"{path}/manifest")


def stale_reasons(stored: dict, wanted: dict) -> list[str]:
    """Why a stored result can't be used again: the parameters that differ; none if it can."""
    return [f"{k} differs ({stored.get(k)} != {v})" for k, v in wanted.items() if str(stored.get(k)) != str(v)]


def stored_or_computed(spark, path: str, wanted: dict, compute, again: bool = False) -> DataFrame:
    """A result with the parameters it was computed for: read if they are the same, else computed and stored below a new name.

    ``compute`` gives the result as a DataFrame.  Results of other parameters are left where they are.
    """
    digest = hashlib.sha256(json.dumps(wanted, sort_keys=True, default=str).encode()).hexdigest()[:16]
    where = f"{path.rstrip('/')}/{digest}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if again or not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        compute().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)
