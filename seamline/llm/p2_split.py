"""Problem 2: oversized items cut into pieces at natural boundaries.

Method: byte-range processing.  An item is taken in ranges with halos; workers find the boundaries of each range on
its own (every decision looks at most ``LOOK`` characters around it, so the halo makes it the same as in the whole
text), the boundary tables are stitched with prefix sums of the range lengths, the cuts are planned on the stitched
tables alone, and pieces are emitted by offset.  An item is planned in blocks of ``BLOCK_PIECES`` limits between
anchors, each of which is a cut that the boundaries just before it decide; so blocks are planned independently and no
row ever holds the table of a whole item.

Both forms share every step.  Values of a table are read by the task that holds the cell; files of any size are read
range by range, each by a task of its own, through any file system that Arrow knows.  Only boundary tables and offsets
move between tasks.

Defined cases: null values, null or non-positive limits and values within the limit give no piece.  An
overlap of half the limit or more, or a negative one, is clamped to [0, half the limit).  Cuts never part CR from LF nor
a base character from its combining marks, joiners or variation selectors, unless such a cluster alone
exceeds the limit.  Redelivered rows are reported once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrow import spread
from .common import cut, once, rows_by_batch

#: Characters that a decision about a boundary looks back or ahead at most, and of the halo on either side of a range.
LOOK, HALO_CHARS = 128, 256
#: Characters of one range of a value of a table.
RANGE_CHARS = 16384
#: Bytes of one range of a file, of its halo, and characters between two known pairs of character and byte offset.
RANGE_BYTES, HALO_BYTES, MARK_CHARS = 8 << 20, 4 * HALO_CHARS, 4096
#: Limits between two anchors.
BLOCK_PIECES = 512

#: Kinds of boundary by strength.
KINDS = {4: "section", 3: "paragraph", 2: "line", 1: "sentence", 0: "word", -1: "none"}
_HEADING = re.compile(rf"(?:#{{1,6}} |def |class |async def |export |function |\[[\w.\"'\-]{{1,{LOOK - 16}}}\][ \t]{{0,8}}\r?\n)")
_BLANK = re.compile(r"[ \t\r]*\Z")
#: A cut stands at the end of what the pattern matches.
_FINE = re.compile(r"(?P<sentence>[.!?…]['\"”’)\]]{0,8}\s|[。！？；]['\"”’）】」]{0,8})|[\s,，、;:]")
_GLUE_CHARS = "̀-ͯ҃-҉֑-ֽً-ٟัิ-ฺ᪰-᫿᷀-᷿‍⃐-⃿︀-️︠-︯\U0001f3fb-\U0001f3ff\U000e0100-\U000e01ef"
_GLUED = re.compile(f"(?<=\r)(?=\n)|(?<=‍)(?=[\\s\\S])|(?<=[\\s\\S])(?=[{_GLUE_CHARS}])")


def glued(text: str, at: int) -> bool:
    """Would a cut before ``text[at]`` part a cluster?"""
    return 0 < at < len(text) and _GLUED.match(text, at) is not None


def scan(chunk: str, begin: int, end: int, limit: int) -> tuple[list[tuple[int, int]], list[int]]:
    """((offset, strength) of the boundaries, offsets that part a cluster) in ``chunk[begin:end]``, counted from ``begin``.

    The rest of ``chunk`` is halo.  Line ends are all kept; sentence ends and words only between line ends that stand
    so far apart that a window of the plan may hold none, and up to the edges of the range.
    """
    parted = [] if chunk.isascii() and "\r" not in chunk else [m.start() - begin for m in _GLUED.finditer(chunk, begin, min(len(chunk), end + 1)) if begin < m.start() <= end]
    bad = set(parted)
    lines: list[tuple[int, int]] = []
    at = chunk.find("\n", begin)
    while 0 <= at < end:
        line = chunk[max(chunk.rfind("\n", max(0, at - LOOK), at) + 1, at - LOOK, 0) : at]
        strength = 4 if _HEADING.match(chunk, at + 1) else 3 if _BLANK.match(line) else 2
        if at + 1 - begin not in bad:
            lines.append((at + 1 - begin, strength))
        at = chunk.find("\n", at + 1)
    found, last = [], 0
    for o, s in [*lines, (end - begin, None)]:
        if last == 0 or s is None or o - last > limit // 4:
            for m in _FINE.finditer(chunk, max(0, begin + last - 16), min(len(chunk), begin + o + 16)):
                f = m.end() - begin
                if last < f < o + (s is None) and f not in bad:
                    found.append((f, 1 if m.lastgroup else 0))
        if s is not None:
            found.append((o, s))
        last = o
    return found, parted


def plan(number: int, length: int, at: list[int], strength: list[int], parted: set[int], limit: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, strength of the cut at the end) of each piece of block ``number``, from boundary tables alone.

    A cut is the strongest boundary of the second half of the limit, the last of equals; without one it stands at the
    limit.  The next piece starts ``overlap`` before it.  The anchor of a block is chosen so in the half limit before
    its end; the tables have to reach two limits before the block.
    """
    overlap = min(max(0, overlap), (limit - 1) // 2)
    block = BLOCK_PIECES * limit

    def whole(place: int, low: int) -> int:
        """The last place at or before ``place`` and after ``low`` that parts no cluster; ``place`` if there is none."""
        back = place
        while back > low and back in parted:
            back -= 1
        return back if back > low else place

    def best(first: int, last: int) -> tuple[int, int]:
        i = max(range(bisect_left(at, first), bisect_right(at, last)), key=lambda i: (strength[i], at[i]), default=None)
        return (whole(last, first), -1) if i is None else (at[i], strength[i])

    def anchor(k: int) -> tuple[int, int]:
        return best(k * block - limit // 2 + 1, k * block)

    stop, kind = anchor(number + 1) if length > (number + 1) * block else (length, -1)
    start = 0
    if number:
        before = anchor(number)[0]
        start = whole(before - overlap, before - overlap - 64)
    while stop - start > limit:
        end, why = best(start + max(limit // 2, overlap + 1), start + limit)
        yield start, end, why
        start = whole(end - overlap, start)
    yield start, stop, kind


def blocks_of(base: int, n: int, length: int, limit: int) -> range:
    """The blocks that boundaries of characters ``base`` to ``base + n`` of an item belong to."""
    block = BLOCK_PIECES * limit
    last = max(0, (length - 1) // block)
    return range(min(last, base // block), min(last, (base + n + 2 * limit) // block) + 1)


def cut_tables(base: int, n: int, length: int, limit: int, found: Iterable[tuple[int, int]], parted: Iterable[int]) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
    """(block, boundaries, parted places) of a range that begins at ``base``, by offsets in the item."""
    block = BLOCK_PIECES * limit
    for k in blocks_of(base, n, length, limit):
        low, high = k * block - 2 * limit - base, (k + 1) * block - base
        yield k, [(o + base, s) for o, s in found if low < o <= high], [o + base for o in parted if low < o <= high]


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut) of the pieces of ``text``: the steps of the method on one item in memory."""
    tables: dict[int, tuple[list, list]] = {}
    for begin in range(0, len(text), RANGE_CHARS):
        left, n = max(0, begin - HALO_CHARS), min(RANGE_CHARS, len(text) - begin)
        found, parted = scan(text[left : begin + n + HALO_CHARS], begin - left, begin - left + n, limit)
        for k, b, p in cut_tables(begin, n, len(text), limit, found, parted):
            held = tables.setdefault(k, ([], []))
            held[0].extend(b)
            held[1].extend(p)
    return [(s, e, KINDS[w]) for k in sorted(tables) for s, e, w in plan(k, len(text), *_columns(tables[k][0]), set(tables[k][1]), limit, overlap)]


def _columns(table: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    return [o for o, _ in table], [s for _, s in table]


#: Columns of ``pieces``.
PIECES = "snapshot_id bigint, field_name string, piece_no int, n_pieces int, start_char int, end_char int, cut_at string, piece string"


def _values(snapshots: DataFrame, limits: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, field_name, value, max_chars, overlap_chars) of the values beyond the limit of their field.

    The limits are looked up for the named fields only, one row each, so what is broadcast is bounded by the
    number of fields.
    """
    bounded = limits.where(F.col("field_name").isin(*fields)).groupBy("field_name").agg(F.min("max_chars").cast("int").alias("max_chars"), F.max("overlap_chars").cast("int").alias("overlap_chars"))
    long = spread(snapshots.select(id_col, *fields)).select(F.col(id_col).cast("bigint").alias("snapshot_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])).alias("v"))
    return (
        long.select("snapshot_id", "v.field_name", "v.value")
        .join(F.broadcast(bounded), "field_name")
        .where("max_chars > 0 and char_length(value) > max_chars")
        .select("snapshot_id", "field_name", "value", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))
    )


def pieces(snapshots: DataFrame, limits: DataFrame, id_col: str = "snapshot_id", fields: tuple[str, ...] = ("full_content", "excerpt")) -> DataFrame:
    """The pieces of every value beyond the limit of its field, in order, by the task that holds the value."""

    def run(ids: list, names: list, values: list, limit: list, overlap: list) -> Iterator[tuple]:
        for i, name, value, m, o in zip(ids, names, values, limit, overlap):
            cuts = split(value, m, o)
            for k, (s, e, kind) in enumerate(cuts):
                yield i, name, k, len(cuts), s, e, kind, value[s:e]

    return rows_by_batch(_values(once(snapshots.select(id_col, *fields), id_col), limits, id_col, fields), PIECES, run)


#: ``found`` holds boundaries as 8 * offset + strength.
TABLE = "begin bigint, n_chars bigint, lim int, overlap int, found array<bigint>, parted array<bigint>"


def planned(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, lim, n, first_no, n_pieces, cuts: the pieces of every block of every item.

    ``ranges`` (keys and the columns of ``TABLE``) may repeat a range.  The prefix sums of the lengths, and those of
    the numbers of pieces, are windows over narrow rows; tables are shuffled by range, then by block.
    """
    kinds = ", ".join(f"{k} {ranges.schema[k].dataType.simpleString()}" for k in keys)
    ranges = cut(ranges)  # the items are read for these tables alone, which two steps need
    narrow = ranges.groupBy(*keys, "begin").agg(F.first("n_chars").alias("n_"))
    by = W.partitionBy(*keys)
    base = F.coalesce(F.sum("n_").over(by.orderBy("begin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.dropDuplicates([*keys, "begin"]).join(narrow.select(*keys, "begin", base.alias("base"), F.sum("n_").over(by).alias("length")), [*keys, "begin"])

    def by_block(*columns: list) -> Iterator[tuple]:
        for *key, n, lim, overlap, found, parted, base, length in zip(*columns):
            for k, b, p in cut_tables(base, n, length, lim, [(x >> 3, x & 7) for x in found], parted):
                yield *key, k, length, lim, overlap, [8 * o + s for o, s in b], p

    tables = rows_by_batch(
        placed.select(*keys, "n_chars", "lim", "overlap", "found", "parted", "base", "length"), f"{kinds}, block int, length bigint, lim int, overlap int, found array<bigint>, parted array<bigint>", by_block
    )
    block = tables.groupBy(*keys, "block", "length", "lim", "overlap").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"), F.flatten(F.collect_list("parted")).alias("parted"))

    def cuts_of(*columns: list) -> Iterator[tuple]:
        for *key, k, length, lim, overlap, found, parted in zip(*columns):
            cuts = [{"start": s, "end": e, "kind": KINDS[w]} for s, e, w in plan(k, length, [b >> 3 for b in found], [b & 7 for b in found], set(parted), lim, overlap)]
            yield *key, k, lim, len(cuts), cuts

    return rows_by_batch(block, f"{kinds}, block int, lim int, n int, cuts array<struct<start:bigint,end:bigint,kind:string>>", cuts_of)


def numbered(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, piece_no, n_pieces, start, end, kind of every piece of ``planned`` blocks."""
    by = W.partitionBy(*keys)
    first = F.coalesce(F.sum("n").over(by.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = blocks.select(*keys, "block", "n").select(*keys, "block", first.alias("first_no"), F.sum("n").over(by).alias("n_pieces"))
    return blocks.join(counts, [*keys, "block"]).select(*keys, "first_no", "n_pieces", F.posexplode("cuts").alias("k_", "c_")).select(*keys, (F.col("first_no") + F.col("k_")).cast("int").alias("piece_no"), "n_pieces", "c_.start", "c_.end", "c_.kind")


def value_blocks(snapshots: DataFrame, limits: DataFrame, id_col: str = "snapshot_id", fields: tuple[str, ...] = ("full_content", "excerpt")) -> DataFrame:
    """``planned`` blocks of the values of a table: only boundary tables leave the task that holds a value."""

    def tables(ids: list, names: list, values: list, limit: list, overlap: list) -> Iterator[tuple]:
        for i, name, text, m, o in zip(ids, names, values, limit, overlap):
            for begin in range(0, len(text), RANGE_CHARS):
                left, n = max(0, begin - HALO_CHARS), min(RANGE_CHARS, len(text) - begin)
                found, parted = scan(text[left : begin + n + HALO_CHARS], begin - left, begin - left + n, m)
                yield i, name, begin, n, m, o, [8 * a + s for a, s in found], parted

    return planned(rows_by_batch(_values(snapshots, limits, id_col, fields), f"snapshot_id bigint, field_name string, {TABLE}", tables), ["snapshot_id", "field_name"])


def found(snapshots: DataFrame, limits: DataFrame) -> DataFrame:
    """The values that the plan cuts."""
    counts = value_blocks(snapshots, limits).groupBy("snapshot_id", "field_name").agg(F.sum("n").alias("n"))
    return counts.where("n > 1").select("snapshot_id", "field_name")


# --- files -------------------------------------------------------------------------------------------------


def _open(path: str):
    """``path`` for random reads, from whatever file system its address names."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _aligned(f, begin: int, end: int, size: int) -> tuple[bytes, int]:
    """Bytes from the first character that starts at or after ``begin`` to the end of the one that starts before ``end``."""
    f.seek(begin)
    raw = f.read(min(end + 4, size) - begin)
    skip = 0
    while begin and skip < 4 and skip < len(raw) and raw[skip] & 0xC0 == 0x80:
        skip += 1
    stop = end - begin
    while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
        stop += 1
    return raw[skip:stop], begin + skip


def file_pieces(files: DataFrame, limit: int, overlap: int, range_bytes: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """path, piece_no, start_char, end_char, cut_at, piece of UTF-8 files of any size that all workers reach.

    ``files`` has path and size_bytes.  Invalid bytes count as U+FFFD.  Ranges are spread over ``tasks`` (as many as
    the session shuffles by) by path and offset, so one giant file uses all of them.
    """
    limit = int(limit)
    spark = files.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = files.select("path", F.col("size_bytes").cast("bigint").alias("size")).where("size > 0").select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))).alias("begin")
    )

    def tables(paths: list, sizes: list, begins: list) -> Iterator[tuple]:
        for path, size, begin in zip(paths, sizes, begins):
            end = min(size, begin + range_bytes)
            with _open(path) as f:
                raw, first = _aligned(f, begin, end, size)
                left, _ = _aligned(f, max(0, begin - HALO_BYTES), begin, size) if begin else (b"", 0)
                right, _ = _aligned(f, end, min(size, end + HALO_BYTES), size) if end < size else (b"", 0)
            body, before = raw.decode("utf-8", "replace"), left.decode("utf-8", "replace")
            marks = [(0, first)]
            for k in range(0, len(body) - MARK_CHARS, MARK_CHARS):
                marks.append((k + MARK_CHARS, marks[-1][1] + len(body[k : k + MARK_CHARS].encode("utf-8"))))
            found, parted = scan(before + body + right.decode("utf-8", "replace"), len(before), len(before) + len(body), limit)
            yield path, begin, len(body), limit, overlap, [8 * a + s for a, s in found], parted, [{"at": a, "byte": b} for a, b in marks]

    scanned = rows_by_batch(ranges.repartition(tasks, "path", "begin"), f"path string, {TABLE}, marks array<struct<at:bigint,byte:bigint>>", tables)
    pieces_ = numbered(planned(scanned.drop("marks"), ["path"]), ["path"])
    # which range a piece begins in: pieces and ranges of one stretch of characters meet
    base = F.coalesce(F.sum("n_chars").over(W.partitionBy("path").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lengths = scanned.select("path", "begin", "n_chars").select("path", "begin", "n_chars", base.alias("base"))
    stretch = max(1, range_bytes // 4)
    covered = scanned.select("path", "begin", "marks").join(lengths, ["path", "begin"]).where("n_chars > 0")
    covered = covered.select("path", "base", "n_chars", "marks", F.explode(F.sequence(F.floor(F.col("base") / stretch), F.floor((F.col("base") + F.col("n_chars") - 1) / stretch))).alias("s_"))
    met = pieces_.withColumn("s_", F.floor(F.col("start") / stretch)).join(covered, ["path", "s_"]).where("start >= base and start < base + n_chars")
    mark = F.element_at(F.filter("marks", lambda x: x["at"] <= F.col("start") - F.col("base")), -1)
    offsets = met.select("path", "piece_no", "start", "end", "kind", (mark["at"] + F.col("base")).alias("mark"), mark["byte"].alias("byte"))

    def emit(paths: list, numbers: list, starts: list, ends: list, kinds: list, marks: list, at_byte: list) -> Iterator[tuple]:
        for path, k, s, e, kind, mark, byte in zip(paths, numbers, starts, ends, kinds, marks, at_byte):
            with _open(path) as f:
                f.seek(byte)
                yield path, k, s, e, kind, f.read(4 * (e - mark) + 4).decode("utf-8", "replace")[s - mark : e - mark]

    spread_out = offsets.repartition(tasks, F.col("path"), F.floor(F.col("piece_no") / 64))
    return rows_by_batch(spread_out, "path string, piece_no int, start_char bigint, end_char bigint, cut_at string, piece string", emit)
