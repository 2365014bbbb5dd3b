"""Operators on lists of files, jobs, names and images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find_json(files: DataFrame, exact: str, suffix: str, contain: str | None = None) -> DataFrame:
    """Of each root the best JSON file: its name is exact, else ends with the suffix, else holds a part; then by shortest and first path."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    rank = F.when(name == exact.lower(), 0).when(F.endswith(name, F.lit(suffix.lower())), 1)
    if contain:
        rank = rank.when(F.contains(name, F.lit(contain.lower())), 2)
    found = files.where(F.endswith("path", F.lit(".json"))).withColumn("rank", rank).where("rank is not null")
    return found.groupBy("root").agg(F.min(F.struct("rank", F.length("path").alias("length"), "path")).alias("best")).select("root", "best.path", "best.rank")


def page_images(files: DataFrame, folder: str, pattern: str) -> DataFrame:
    """The PNG files of a folder of each root whose names match, with the page number that the pattern captures."""
    name = F.regexp_extract("path", rf"^{folder}/([^/]+\.png)$", 1)
    number = F.regexp_extract(name, f"^{pattern}", 1)
    return files.where((name != "") & (number != "")).select("root", "path", number.cast("long").alias("page"))


def manifest(images: DataFrame) -> DataFrame:
    """Of each job the number of images, of kinds, and all pages that any list names, ascending."""
    return images.groupBy("job").agg(F.count("*").alias("images"), F.count_distinct("kind").alias("kinds"), F.sort_array(F.collect_set("page")).alias("pages"))


def job_keys(keys: DataFrame, prefix: str = "job:", flag: str = ":cancel") -> DataFrame:
    """Ids of the keys with the prefix that are no flags."""
    return keys.where(F.startswith("key", F.lit(prefix)) & ~F.contains("key", F.lit(flag))).select(F.substring("key", len(prefix) + 1, 1 << 30).alias("id"))


def cancellable(jobs: DataFrame, flags: DataFrame, open_statuses: Sequence[str]) -> DataFrame:
    """The jobs with ``cancelled``: they are flagged, and open as long as they were not done."""
    marked = flags.select("job").distinct().withColumn("flag", F.lit(True))
    return jobs.join(marked, "job", "left").withColumn("cancelled", F.coalesce(F.col("flag") & F.col("status").isin(*open_statuses), F.lit(False))).drop("flag")


def matching_jobs(jobs: DataFrame, status: str = "all", keyword: str = "") -> DataFrame:
    """Jobs of a status whose id or stage holds the keyword, whatever its case."""
    out = jobs if status == "all" else jobs.where(F.col("status") == status)
    word = keyword.strip().lower()
    return out.where(F.contains(F.lower("job_id"), F.lit(word)) | F.contains(F.lower(F.coalesce("stage", F.lit(""))), F.lit(word))) if word else out


def in_pages(rows: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Rows of the pages start to end, counted from 1 and both included; all rows unless both are given."""
    if start is None or end is None:
        return rows
    if start <= 0 or end <= 0 or start > end:
        raise ValueError(f"no page range: {start} to {end}")
    return rows.where((F.col("page") + 1).between(start, end))


def suggestions(names: DataFrame, query: str, most: int = 16) -> DataFrame:
    """Names in order of pos, once whatever their case: those that begin with the query, then those that hold it; all if none does."""
    word = query.strip().lower()
    key = F.lower(F.trim("name"))
    firsts = names.where(key != "").groupBy(key.alias("key")).agg(F.min(F.struct("pos", "name")).alias("first")).select("first.pos", "first.name", "key")
    rank = F.when(F.startswith("key", F.lit(word)), 0).when(F.contains("key", F.lit(word)), 1) if word else F.lit(0)
    ranked = firsts.withColumn("rank", rank)
    some = ranked.where("rank is not null")
    # the most rows of either side reach one task
    best = some.orderBy("rank", "pos").limit(most)
    spare = ranked.withColumn("rank", F.lit(2)).orderBy("pos").limit(most)
    both = best.unionByName(spare).withColumn("matched", F.max((F.col("rank") < 2).cast("int")).over(Window.partitionBy(F.lit(0))))
    kept = both.where((F.col("rank") < 2) | (F.col("matched") == 0))
    return kept.select("name", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank", "pos")).cast("long").alias("place"))


def overlaid(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All keys of both; where both have a value, the right one's."""
    values = [c for c in left.columns if c != key]
    joined = left.alias("l").join(right.alias("r"), key, "full_outer")
    return joined.select(key, *[F.coalesce(f"r.{c}", f"l.{c}").alias(c) for c in values])


def chunked(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: int = 80) -> DataFrame:
    """``chunk`` from 0: so many rows of each group, in order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("chunk", F.floor((place - 1) / size))


def numbered(rows: DataFrame, by: str, order: str, first: int = 0) -> DataFrame:
    """``number`` of each row within its group, in order."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long") + (first - 1))


def expired(folders: DataFrame, jobs: DataFrame, now: Column, seconds: int, terminal: Sequence[str]) -> DataFrame:
    """Folders (dir, mtime) with ``gone``: their job has ended and its time is over, or they have no job and are as old as a job may get.

    ``jobs`` has job, status and expires_at; jobs that have not ended keep their folder.
    """
    joined = folders.join(jobs, F.col("dir") == F.col("job"), "left")
    over = F.col("status").isin(*terminal) & (F.col("expires_at") <= now)
    old = F.unix_micros(F.col("mtime").cast("timestamp")) <= F.unix_micros(now.cast("timestamp")) - max(60, seconds) * 1_000_000
    return joined.select("dir", F.coalesce(F.when(F.col("job").isNull(), old).otherwise(over), F.lit(False)).alias("gone"))


def cleanup_stats(folders: DataFrame) -> DataFrame:
    return folders.agg(F.count("*").alias("scanned"), F.count_if("gone").alias("deleted"))


#: Marks in warnings and what users are told, the first that fits.
MESSAGES = (
    ("ocr_setup_failed_best_effort", "OCR 初始化失败，已降级为图片模式"),
    ("ocr_failed_best_effort", "部分页面 OCR 失败，已降级为图片模式"),
    ("ocr_empty_result", "部分页面 OCR 未识别到文字"),
    ("ocr_linebreak_assist_heuristic_only", "OCR 行拆分未使用 AI 模型，已改为启发式模式"),
    ("ocr_page_provider_switches", "OCR 在任务内发生了 provider 切换，请检查调试产物"),
    ("ocr_page_fallbacks", "部分页面 OCR 发生了回退，请检查调试产物"),
    ("ocr_ai_provider_disabled", "AI OCR 在任务中途被停用，后续页面改走本地链路"),
    ("paddle_vl_sparse_slide_layout", "PaddleOCR-VL 当前页识别结果偏粗，可能漏掉流程图小字；这类页面更建议用 DeepSeek OCR / Qwen"),
    ("layout_assist_status=failed", "AI 版式辅助失败，使用原始布局"),
    ("layout_assist_status=skipped_missing_provider", "AI 版式辅助未执行：缺少可用 AI 配置"),
)


def user_messages(warnings: Column) -> Column:
    """What users are told about a list of warnings, each once, in order; unknown warnings say nothing."""

    def message(text: Column) -> Column:
        out = F.lit(None).cast("string")
        for mark, said in reversed(MESSAGES):
            out = F.when(F.contains(text, F.lit(mark)), said).otherwise(out)
        return out

    return F.array_distinct(F.filter(F.transform(warnings, message), lambda m: m.isNotNull()))
