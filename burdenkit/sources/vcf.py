"""Variant call files: headers, variant lines, long calls.

All functions take a frame of lines (column value), as ``lines`` reads them. Plain and bzip2 files split;
a gzip file is one task, so its lines are dealt out before they are parsed.
"""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as g
from ..operators.intervals import points_in_regions

FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


def codec(path: str) -> str | None:
    """The compression that a file name stands for: gz and z gzip (block gzip too), bz and bz2 bzip2."""
    return {"gz": "gzip", "z": "gzip", "bz": "bzip2", "bz2": "bzip2"}.get(path.rsplit("/", 1)[-1].rsplit(".", 1)[-1])


def lines(spark: SparkSession, path: str, chunk: int = 32 << 20) -> DataFrame:
    """Lines of a text file or folder, in no order. Plain text and bz2 split; so does block gzip (.z, .gz), in ranges of ``chunk`` bytes.

    Other gzip files and .bz ones are a task a file, which unpacks them as it reads.
    """
    kind = codec(path)
    if kind is None or path.endswith(".bz2"):
        return spark.read.text(path)
    files = [(r["path"], r["length"]) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]  # a row per file; contents aren't read
    ranges = [(f, at, min(n, at + chunk), n) for f, n in files for at in range(0, max(n, 1), chunk)]
    parts = spark.createDataFrame(ranges, "path string, start long, end long, length long").repartition(max(1, len(ranges)), "path", "start")

    def read(batches):
        for batch in batches:
            for path, start, end, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _range_lines(path, start, end, length) if kind == "gzip" else _whole_lines(path, start)
                while part := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], names=["value"])

    return parts.mapInArrow(read, "value string")


#: A block of block gzip starts with these bytes; two more, behind a field named BC, hold its length less one.
_MAGIC = b"\x1f\x8b\x08\x04"


def _opened(path: str):
    """A file that tasks can read from any place: a local path or an address of a file system that pyarrow knows."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")
    return system.open_input_file(name)


def block_length(head: bytes) -> int | None:
    """Length of the block that starts with these bytes; None where none does."""
    if len(head) < 18 or not head.startswith(_MAGIC):
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def _first_block(source, start: int, length: int) -> int:
    """Where the first block at or behind ``start`` begins: its header is real if another one, or the end, follows it."""
    window = 1 << 18  # blocks are under 64 KB
    data = source.read_at(min(window, length - start), start)
    at = data.find(_MAGIC)
    while at >= 0:
        size = block_length(data[at : at + 64])
        if size and (start + at + size == length or block_length(source.read_at(min(64, length - start - at - size), start + at + size)) is not None):
            return start + at
        at = data.find(_MAGIC, at + 1)
    return length


def _range_lines(path: str, start: int, end: int, length: int):
    """Lines that begin in blocks starting in [start, end). Every range but the first leaves out what stands before its first
    line end, as the range before it goes on to the end of its last line. A file without blocks is read whole by its first range."""
    import zlib

    with _opened(path) as source:
        if block_length(source.read_at(min(64, length), 0)) is None:
            if start == 0:
                yield from _whole_lines(path, 0)
            return
        at = _first_block(source, start, length) if start else 0
        if at >= end:
            return
        rest, skip = b"", start > 0
        while at < length:
            size = block_length(source.read_at(min(64, length - at), at))
            if size is None:
                raise ValueError(f"no block at {at} of {path}")
            data = zlib.decompress(source.read_at(size, at), 31)
            if at >= end:  # the line that has begun, or begins right here, and no more
                if skip:
                    return
                line, found, _ = data.partition(b"\n")
                rest += line
                if found:
                    break
                at += size
                continue
            if skip:
                _, found, data = data.partition(b"\n")
                skip = not found
                if skip:
                    at += size
                    continue
            *whole, rest = (rest + data).split(b"\n")
            yield from (x.decode() for x in whole)
            at += size
        if rest or (not skip and at < length):
            yield rest.decode()


def _whole_lines(path: str, start: int):
    import bz2
    import gzip

    if start:
        return
    with _opened(path) as source:
        opened = (gzip if codec(path) == "gzip" else bz2).open(source, "rt", encoding="utf-8")
        for line in opened:
            yield line.rstrip("\n")


def blocks(data: bytes, size: int = 60_000):
    """Block gzip of some bytes: independent members that say how long they are."""
    import zlib

    for at in range(0, len(data), size):
        part = data[at : at + size]
        packed = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packed.compress(part) + packed.flush()
        yield _MAGIC + bytes(4) + b"\x00\xff\x06\x00BC\x02\x00" + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little")


def write_block_gzip(text: DataFrame, folder: str, extension: str = "z") -> int:
    """Write lines (column value) as block gzip, a file per partition, and return their number. A task's file gets its name when it is complete."""

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, at = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        system.create_dir(at, recursive=True)
        name, n, rest = f"{at}/part-{task.partitionId():05d}.{extension}", 0, b""
        with system.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
            for batch in batches:
                values = batch.column(0).to_pylist()
                n, rest = n + len(values), rest + "".join(f"{x}\n" for x in values).encode()
                if len(rest) > 1 << 20:
                    out.write(b"".join(blocks(rest)))
                    rest = b""
            out.write(b"".join(blocks(rest)))
        system.move(f"{name}.{task.taskAttemptId()}.tmp", name)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return text.select("value").mapInArrow(write, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0


def inside(text: DataFrame, intervals: DataFrame, order: str) -> DataFrame:
    """``order``, value: header lines and the variant lines at positions within ``intervals`` (chr, pos_min, pos_max, disjoint), as they were.

    ``text``: value and ``order``, the line's place in its file, which ``reports.write_lines`` writes by.
    """
    head = text.filter(F.col("value").startswith("#")).select(order, "value")
    f = F.split("value", "\t", 3)
    body = text.filter(~F.col("value").startswith("#")).select(order, "value", g.chromosome_code(f[0]).cast("long").alias("chr"), f[1].try_cast("bigint").alias("pos"))
    return head.unionByName(points_in_regions(body, intervals, how="left_semi").select(order, "value"))


def builds(text: DataFrame) -> DataFrame:
    """Assemblies named by the contig lines of chromosomes 1-22, X and Y."""
    head = text.filter(F.col("value").startswith("##contig="))
    name = F.regexp_extract("value", r"ID=(?:chr)?([^,>]+)", 1)
    known = head.filter(g.chromosome_code(name) <= 24)
    return known.select(F.regexp_extract("value", r"assembly=([^,>]+)", 1).alias("build")).filter("build <> ''").distinct()


def sample_names(text: DataFrame) -> DataFrame:
    """pos (from 0) and name of the samples in the column header line."""
    head = text.filter(F.col("value").startswith("#CHROM")).select(F.split("value", "\t").alias("f"))
    return head.select(F.posexplode(F.expr("slice(f, 10, size(f))")).alias("pos", "name"))


def header_errors(text: DataFrame) -> DataFrame:
    """Column header lines that have too few fields or other names than the nine fixed ones."""
    head = text.filter(F.col("value").startswith("#CHROM")).select(F.split("value", "\t").alias("f"))
    return head.filter((F.size("f") < 9) | (F.upper(F.array_join(F.expr("slice(f, 1, 9)"), "\t")) != "\t".join(("#CHROM", *(x.upper() for x in FIXED[1:])))))


def variants(text: DataFrame, passing: bool = True) -> DataFrame:
    """The fixed fields and the array calls of each variant line; with ``passing`` those whose FILTER is '.' or 'PASS'."""
    rows = text.filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    made = rows.select(*[F.try_element_at("f", F.lit(k + 1)).alias(n) for k, n in enumerate(FIXED)], F.expr("slice(f, 10, size(f))").alias("calls"))
    made = made.withColumn("pos", F.col("pos").try_cast("bigint"))
    return made.filter(g.filter_passes(F.col("filter"))) if passing else made


def wrong_lengths(rows: DataFrame, samples: int) -> DataFrame:
    """Variants with another number of calls than there are samples."""
    return rows.filter(F.size("calls") != samples)


def long_calls(rows: DataFrame, star_as_reference: bool = True) -> DataFrame:
    """chr, pos, id, sample (position from 0), a1, a2 of each call; null alleles are missing calls.

    A call is missing where it is '.', where FT is there and neither PASS nor '.', or where GT has not two
    called alleles. Alleles are coded before the explode, a locus being one row.
    """
    chrom = g.chromosome_code(F.col("chrom"))
    label = g.locus_label(F.col("id"), chrom, F.col("pos"), F.col("ref"))
    alleles = g.allele_list(F.col("ref"), F.col("alt"))
    coded = F.transform("calls", lambda c: g.star_as(alleles, g.call_alleles(g.kept_call(c, F.col("format"))), star_as_reference))
    each = rows.select(chrom.cast("long").alias("chr"), "pos", label.alias("id"), F.posexplode(coded).alias("sample", "call"))
    return each.select("chr", "pos", "id", "sample", F.col("call")[0].alias("a1"), F.col("call")[1].alias("a2"))


def merged(parts: DataFrame, fill_reference: bool = False, drop_absent: bool = False) -> DataFrame:
    """Variants of several files brought together by position: file, chr, pos, ref, alleles, sample, call.

    ``parts``: file, chr, pos, ref, alt, sample, call (GT). Alleles are renumbered in one list: the reference,
    then all alternatives in order. Files that lack a position have missing calls (no rows), or 0/0 if
    ``fill_reference`` and the files agree on REF, or the position goes if ``drop_absent``.
    """
    sites = parts.groupBy("chr", "pos").agg(F.min("ref").alias("_ref"), F.count_distinct("ref").alias("_refs"), F.count_distinct("file").alias("_files"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("alt", ","))))).alias("_alts"))
    files = parts.select("file", "sample").distinct()
    n = parts.select("file").distinct().agg(F.count("*").alias("_all"))
    sites = sites.join(F.broadcast(n))
    if drop_absent:
        sites = sites.filter("_files = _all")
    alleles = F.concat(F.array("_ref"), F.array_remove("_alts", F.col("_ref")))
    x = parts.join(sites, ["chr", "pos"])
    own = F.split(F.concat_ws(",", "ref", "alt"), ",")

    def renumbered(k: int):
        at = F.try_element_at(F.split("call", "[/|]"), F.lit(k)).try_cast("int")
        return (F.array_position(alleles, F.try_element_at(own, at + 1)) - 1).cast("string")

    call = F.coalesce(F.concat(renumbered(1), F.lit("/"), renumbered(2)), F.lit("./."))
    out = x.select("file", "chr", "pos", F.col("_ref").alias("ref"), F.array_join(alleles, ",").alias("alleles"), "sample", call.alias("call"))
    if not fill_reference:
        return out
    have = parts.select("chr", "pos", "file").distinct()
    lacking = sites.filter("_files < _all AND _refs = 1").join(F.broadcast(files.select("file").distinct())).join(have, ["chr", "pos", "file"], "left_anti")
    filled = lacking.join(F.broadcast(files), "file").select("file", "chr", "pos", F.col("_ref").alias("ref"), F.array_join(alleles, ",").alias("alleles"), "sample", F.lit("0/0").alias("call"))
    return out.unionByName(filled)
