"""Reading file trees for vetting and audit logs, and writing logs and receipts."""

from __future__ import annotations

import os
import stat
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.audit import is_blank

_TREE = "root string, path string, size bigint, text string, status string"


def _hidden_files(fs: object, top: object, prefix: str) -> list[tuple[str, int, object]]:
    """Path below the tree, size and Hadoop path of the files with a name on the way that Spark's readers skip."""
    out, files = [], fs.listFiles(top, True)
    while files.hasNext():
        file = files.next()
        at = file.getPath().toString().removeprefix(prefix)
        if any(name[:1] in ("_", ".") for name in at.split("/")):
            out.append((at, file.getLen(), file.getPath()))
    return sorted(out, key=lambda x: x[0].split("/"))


def _read_hidden(spark: SparkSession, fs: object, found: list[tuple[str, int, object]], root: str) -> DataFrame:
    """Their rows. The driver reads them, no more than vetting's budgets of a tree let it scan."""
    from wardline.operators.vetting import FILE_BYTES, TREE_BYTES

    rows, left = [], TREE_BYTES
    for at, size, path in found:
        text = None
        if size <= FILE_BYTES and size <= left:
            stream = fs.open(path)
            try:
                text = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
            finally:
                stream.close()
            left -= size
        rows.append((root, at, size, text, None if size > FILE_BYTES or text is not None else "unresolved"))
    return spark.createDataFrame(rows, _TREE)


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """``root``, ``path`` (relative), ``size``, ``text`` and ``status`` of all files below ``root`` in any file system Spark reads.

    Files over the size cap are listed but not read: their text is null. Files that Spark's readers take for hidden (a
    name on the way begins with a point or an underscore) are found and read by the driver, as far as vetting's
    budget of bytes goes; others of those have the status ``unresolved``. A target that can't be vetted (an empty
    path, nothing there, a device) and a tree without files give one row without a path; for the former the status says why.
    """
    from wardline.operators.vetting import EMPTY_PATH, FILE_BYTES, MISSING, NOT_REGULAR

    alone = lambda why: spark.createDataFrame([(root, None, None, None, why)], _TREE)
    if not (root or "").strip():
        return alone(EMPTY_PATH)
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.makeQualified(top)
    if not fs.exists(top):
        return alone(MISSING)
    if top.toUri().getScheme() == "file" and not _regular(top.toUri().getPath()):
        return alone(NOT_REGULAR)
    one = fs.getFileStatus(top).isFile()
    prefix = (top.getParent() if one else top).toString().rstrip("/") + "/"
    if one and top.getName()[:1] in ("_", "."):
        return _read_hidden(spark, fs, [(top.getName(), fs.getFileStatus(top).getLen(), top)], root)
    hidden = [] if one else _hidden_files(fs, top, prefix)
    if not fs.getContentSummary(top).getFileCount():
        return alone(None)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    # the readers skip the content where a filter or the columns asked for allow it
    read = files.where(F.col("length") <= FILE_BYTES).select("path", "length", text.alias("text"))
    listed = files.where(F.col("length") > FILE_BYTES).select("path", "length", F.lit(None).cast("string").alias("text"))
    both = read.unionByName(listed).select(F.lit(root).alias("root"), F.substr("path", F.lit(len(prefix) + 1)).alias("path"), F.col("length").alias("size"), "text", F.lit(None).cast("string").alias("status"))
    return both.unionByName(_read_hidden(spark, fs, hidden, root)) if hidden else both


def _regular(path: str) -> bool:
    mode = os.stat(path).st_mode
    return stat.S_ISREG(mode) or stat.S_ISDIR(mode)


def linked_tree(spark: SparkSession, root: str) -> DataFrame:
    """As file_tree() for a local folder with links: links that leave the tree get a ``status`` and are not read."""
    top = os.path.realpath(root)
    links = []
    for folder, dirs, names in os.walk(top):
        for name in [*names, *[d for d in dirs if os.path.islink(os.path.join(folder, d))]]:
            at = os.path.join(folder, name)
            if os.path.islink(at):
                real = os.path.realpath(at)
                inside = real == top or real.startswith(top + os.sep)
                status = None if inside and os.path.exists(real) else "outside" if not inside else "unresolved"
                if status:
                    links.append((root, os.path.relpath(at, top).replace(os.sep, "/"), 0, "", status))
    if not os.path.isdir(top):
        return file_tree(spark, root)
    files = file_tree(spark, "file://" + top).withColumn("root", F.lit(root))
    if not links:
        return files
    left = spark.createDataFrame(links, _TREE)
    return files.join(left.select("path"), "path", "left_anti").select(*left.columns).unionByName(left)


def audit_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``log_id`` (the file), ``line_no`` and ``raw`` of logs of JSON lines; lines end at line feeds alone.

    A file is split like any text. ``line_no`` grows with a line's place in its file, but is no count: its high bits are
    the place of the split that the line begins in, which the offset of the split in the file gives.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 31) - 1)).alias("k"), F.col("value").alias("raw"))
    return lines.where(~is_blank(F.col("raw"))).select("log_id", (F.shiftleft(F.shiftright("block", 10), 32) + F.col("k") + 1).alias("line_no"), "raw")


class AuditWriteError(RuntimeError):
    """A log that fails closed could not be written."""


def write_lines(chained: DataFrame, path: str, fail_mode: str = "open") -> bool:
    """Append chained rows as JSON lines, a folder a log, in order within the log; True if they are written.

    Each call adds files of whole lines, so what an earlier writer left torn stays a line of its own. Where writing
    fails, a log that fails ``open`` says so on standard error and returns False, one that fails ``closed`` raises
    AuditWriteError (see the presets' ``fail_mode``).
    """
    if fail_mode not in ("open", "closed"):
        raise ValueError("fail_mode must be open or closed")
    ordered = chained.repartition("log_id").sortWithinPartitions("log_id", "line_no")
    try:
        ordered.select("log_id", F.col("raw").alias("value")).write.partitionBy("log_id").mode("append").text(path)
    except Exception as e:  # noqa: BLE001  whatever stops the write must not stop what is logged
        if fail_mode == "closed":
            raise AuditWriteError(str(e)) from e
        print(f"wardline audit: log write failed (fail-open, not blocking): {e}", file=sys.stderr)
        return False
    return True


def write_receipts(heads: DataFrame, path: str | None = None, shipper: Callable[[DataFrame], None] | None = None) -> None:
    """Hand due heads to the user's ``shipper``, which comes first, or append them as JSON lines with a time."""
    stamped = heads.withColumn("anchored_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
    if shipper is not None:
        shipper(stamped)
    elif path is not None:
        stamped.write.mode("append").json(path)
