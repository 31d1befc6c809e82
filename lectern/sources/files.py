"""Files in and out: text documents, classification, audit rows, exam papers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import document_type, file_extension

MAX_BYTES = 100 << 20
#: Partitions of small files that one task reads.
PARTS_A_TASK = 16
#: Fixed values.
TYPE_LABELS = {"choice": "单选题", "fill": "填空题", "short": "简答题"}


def decoded(content: bytes) -> str:
    """UTF-8, else GBK with what is in neither left out."""
    try:
        return content.decode()
    except UnicodeDecodeError:
        return content.decode("gbk", errors="ignore")


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, format, text) of ``.md``, ``.markdown`` and ``.txt`` files below a folder; each is UTF-8 or else GBK. Empty files are no documents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = files.filter(file_extension(name).isin(".md", ".markdown", ".txt"))
    # Spark counts a file as 4 MB at least, which makes a task of each 32 small ones.
    parts = files.rdd.getNumPartitions()
    files = files.coalesce(max(-(-parts // PARTS_A_TASK), min(parts, 4 * spark.sparkContext.defaultParallelism)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, texts, held = 0, [], 0
            for k in range(batch.num_rows):  # small files together, as files may be large
                texts.append(decoded(batch.column(1)[k].as_py() or b""))
                held += len(texts[-1])
                if held > 1 << 20 or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(texts, pa.string())], ["path", "text"])
                    first, texts, held = k + 1, [], 0

    rows = files.mapInArrow(decode, "path string, text string")
    kind = F.when(file_extension(name) == ".txt", "txt").otherwise("markdown")
    return rows.select("path", F.regexp_replace(name, r"\.[^.]+$", "").alias("title"), kind.alias("format"), "text")


def write_text_documents(docs: DataFrame, path: str) -> DataFrame:
    """Writes (name, text, encoding) as files in a folder that all executors reach; (name, bytes) of what was written.

    A file is written whole under its name, so a task that runs again leaves the same files. The result is to be read once.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        at, folder = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        at.create_dir(folder, recursive=True)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, text, encoding in zip(names, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                content = (text or "").encode(encoding or "utf-8", errors="replace")
                with at.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return docs.select("name", "text", "encoding").mapInArrow(write, "name string, bytes bigint")


def classify(files: DataFrame, name: Column, size: Column) -> DataFrame:
    """Adds kind (NULL if unsupported) and reason (NULL if accepted)."""
    reason = F.when(F.col("kind").isNull(), "unsupported type").when(size > MAX_BYTES, "too large").when(size == 0, "empty")
    return files.withColumn("kind", document_type(name)).withColumn("reason", reason)


def append_audit(rows: DataFrame, path: str) -> None:
    """Audit rows are only ever added, in a folder for each day. ``lectern.streaming.streams.append_audit`` does it from a stream, once each."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def exam_markdown(papers: DataFrame, questions: DataFrame, with_answer: bool = True) -> DataFrame:
    """(paper_id, markdown): header, questions by qid, then the answers unless the paper's reader may not see them.

    ``papers``: paper_id, title, difficulty, total_score, iterate_count, role; ``questions``: paper_id,
    qid, type, stem, options, answer, knowledge_point, score.
    """
    label = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in TYPE_LABELS.items()], F.lit("题目"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    options = F.concat(F.lit("\n- "), F.array_join("options", "\n- "))
    asked = F.concat(F.lit("## 第"), text(F.col("qid")), F.lit("题（"), label, F.lit("，"), text(F.col("score")), F.lit(" 分）\n"), text(F.col("stem")),
                     F.when(F.size("options") > 0, options).otherwise(""), F.lit("\n"))
    point = F.when(F.col("knowledge_point") != "", F.concat(F.lit("\n*知识点："), "knowledge_point", F.lit("*"))).otherwise("")
    told = F.concat(F.lit("## 第"), text(F.col("qid")), F.lit("题\n"), text(F.col("answer")), point, F.lit("\n"))
    body = F.array_sort(F.collect_list(F.struct("qid", asked.alias("asked"), told.alias("told"))))
    part = lambda f: F.array_join(F.transform("body", lambda x: x[f]), "\n")
    rows = papers.join(questions.groupBy("paper_id").agg(body.alias("body")), "paper_id", "left")
    head = F.concat(F.lit("# "), text(F.col("title")), F.lit("\n\n难度："), text(F.col("difficulty")), F.lit("　总分："), text(F.col("total_score")),
                    F.lit("\n迭代次数："), text(F.col("iterate_count")), F.lit("\n\n"))
    answers = F.concat(F.lit("\n---\n\n# 参考答案\n\n"), part("told"))
    shown = F.lit(with_answer) & (F.col("role") != "read") & (F.size("body") > 0)
    return rows.select("paper_id", F.concat(head, F.coalesce(part("asked"), F.lit("")), F.when(shown, answers).otherwise("")).alias("markdown"))


def write_markdown(papers: DataFrame, path: str) -> None:
    """One text record for each paper, in the file format of Spark's text writer."""
    papers.select("markdown").write.mode("overwrite").option("lineSep", "\n\n").text(path)
