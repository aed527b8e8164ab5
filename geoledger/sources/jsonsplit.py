"""JSON files of any size, read by many tasks: the objects of a root array or of a member array, in their order.

Spark splits a text file at a line separator. Here the separator is the closing brace, so a file without a line break is still
dealt to many tasks. Whether a record starts inside a string, and how many braces and brackets are open there, follows from
all records before it. So the file is read twice: first each block (what a task reads at a time) is summed up for both
cases, inside a string or not, and the sums of earlier blocks give the state in which a block starts; then each block is cut
into objects from that state. Only an object that crosses a block's end is shuffled. What stands around the objects is the
file's skeleton, which is small and holds the head.

Marks are counted on the JVM side; Python follows one state a record and keeps no more than an object. The text of one
object, and the skeleton of one file, must fit a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoledger.session import cut

BROADCAST_BLOCKS = 1_000_000  # one row of some 100 bytes a block; of 128 MB each, a hundred terabytes have 800,000
ROWS_OUT = 2000
SKELETON_SHOWN = 1000  # characters of what cannot be read
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|\{', re.S)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)', re.S)
_END_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_OPENED_ARRAY = re.compile(r'(?:"((?:[^"\\]|\\.)*)"[ \t\r\n]*:[ \t\r\n]*)?\[[ \t\r\n]*$', re.S)
_BLANK = " \t\r\n"


@dataclass
class JsonObjects:
    """``objects``: path, idx (place among the file's objects), text. ``files``: path, skeleton (the text around the objects),
    objects (their number), fault (the structure is broken); one row for each file, empty ones included."""

    objects: DataFrame
    files: DataFrame


def _occurrences(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Records with the braces and brackets they open, read outside (0) or inside (1) a string, and their quotes."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    outside, inside = (F.regexp_replace(F.concat(F.lit(p), plain), '"[^"]*+(?:"|$)', "") for p in ("", '"'))
    return raw.select(
        "*", F.octet_length("value").alias("bytes"), _occurrences(plain, '"').alias("quotes"),
        _occurrences(outside, "{").alias("opened0"), _occurrences(inside, "{").alias("opened1"),
        (_occurrences(outside, "[") - _occurrences(outside, "]")).alias("brackets0"), (_occurrences(inside, "[") - _occurrences(inside, "]")).alias("brackets1"))


_SUMS = ("quotes", "braces0", "braces1", "brackets0", "brackets1", "bytes")


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its quotes and what it leaves open when read from outside or from inside a string."""
    key, total = None, [0] * len(_SUMS)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("path", "file_size", "block", *_SUMS), (*key, *total)))], schema=_SUMS_SCHEMA)

    for batch in batches:
        d = batch.to_pydict()
        for own, n_bytes, quotes, o0, o1, b0, b1 in zip(
                zip(d["path"], d["file_size"], d["block"]), d["bytes"], d["quotes"], d["opened0"], d["opened1"], d["brackets0"], d["brackets1"]):
            if own != key:
                if key is not None:
                    yield row()
                key, total = own, [0] * len(_SUMS)
            turned = total[0] % 2  # whether the record's case is the other one than that of its block
            for state, name in ((0, 1), (1, 2)):
                now = state ^ turned
                total[name] += (o1 if now else o0) - ((quotes + now) % 2 == 0)
                total[name + 2] += b1 if now else b0
            total[0] += quotes
            total[5] += n_bytes + 1
    if key is not None:
        yield row()


_SUMS_SCHEMA = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("file_size", "block", *_SUMS))])


def _block_states(records: DataFrame) -> DataFrame:
    """(path, block) with the state at its start, whether the file ends without a separator there, and whether the file is at fault."""
    narrow = records.drop("value", "pos")
    sums = cut(narrow.mapInArrow(_block_sums, "path string, " + ", ".join(f"{c} long" for c in ("file_size", "block", *_SUMS))))
    order, whole = Window.partitionBy("path").orderBy("block"), Window.partitionBy("path")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    known = sums.withColumn("state", so_far("quotes") % 2).withColumn("surplus", F.sum("bytes").over(whole) - F.col("file_size"))
    for name in ("braces", "brackets"):
        known = known.withColumn(name, F.when(F.col("state") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1")))
    open_end = F.col("surplus") == 1  # one byte more than the file has: its last record does not end with a separator
    last_outside = F.sum("quotes").over(whole) % 2 == 0
    # such a record was counted as closing a brace that is not there
    unclosed = F.sum("braces").over(whole) + F.when(open_end & last_outside, 1).otherwise(0)
    fault = ~F.col("surplus").isin(0, 1) | ~last_outside | (unclosed != 0) | (F.sum("brackets").over(whole) != 0)
    return cut(known.select("path", "block", "state", so_far("braces").alias("depth"), so_far("brackets").alias("bracket"),
                            (open_end & (F.col("block") == F.max("block").over(whole))).alias("open_end"), fault.alias("file_fault")))


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bool]]:
    """Records with the mark whether they are the last one of their block."""
    held = None
    for batch in batches:
        for row in batch.to_pylist():
            if held is not None:
                yield held, (held["path"], held["block"]) != (row["path"], row["block"])
            held = row
    if held is not None:
        yield held, True


def find_brace(text: str, in_string: bool, number: int) -> int:
    """The place of the ``number``-th brace outside strings (from 1)."""
    at = _END_OF_STRING.match(text).end() if in_string else 0
    for token in _TOKEN.finditer(text, at):
        if token.group() == "{":
            number -= 1
            if not number:
                return token.start()
    raise ValueError("no such brace")


def _bare_brackets(text: str, in_string: bool) -> int:
    bare = _STRING.sub("", '"' + text if in_string else text)
    return bare.count("[") - bare.count("]")


_PARTS = pa.schema([("path", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("lead", pa.string()), ("text", pa.string()), ("begins", pa.bool_()),
                    ("ends", pa.bool_()), ("level", pa.int64()), ("key", pa.string()), ("known", pa.int64()), ("unknown", pa.int64()), ("fault", pa.bool_())])


def _cut_blocks(outer: int, member: str | None):
    """Cut the records of each block into objects that open at depth ``outer``.

    A row is an object or the part of one that lies in the block (``begins``, ``ends``), with the text before it (``lead``), the
    brackets open around it (``level``) and the name of the array last opened in this block (``key``). A row without
    text holds what follows the last object.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key_of_block = [], None
        for r, last in _with_last(batches):
            if (r["path"], r["block"]) != key_of_block:
                key_of_block, first = (r["path"], r["block"]), True
                state, depth, bracket = r["state"], r["depth"], r["bracket"]
                n, lead, lead_state, text, begins, key, known, unknown, level, fault = 0, [], state, [], False, None, 0, 0, 0, False
            else:
                first = False
            value, open_end = r["value"], last and r["open_end"]
            opened, brackets = (r["opened1"], r["brackets1"]) if state else (r["opened0"], r["brackets0"])
            closed = (r["quotes"] + state) % 2 == 0 and not open_end
            whole = value if open_end else value + "}"
            if depth == 0 and member is not None and not (first and r["block"] == 0) and value.strip(_BLANK):
                fault = True  # something follows the root object
            if depth > outer:
                text.append(whole)
            elif depth + opened <= outer:
                lead.append(whole)
            else:
                at = find_brace(value, bool(state), outer - depth + 1)
                lead.append(value[:at])
                before = "".join(lead)
                level = bracket + _bare_brackets(value[:at], bool(state))
                array = None if lead_state else _OPENED_ARRAY.search(before)
                if array:
                    key = array.group(1) or ""
                elif level and not before.strip(_BLANK) and n:
                    fault = True  # no comma between two objects
                n, begins, text = n + 1, True, [whole[at:]]
                here = level == 1 or (member is None and level == 0)
                known += here and (member is None or key == member)
                unknown += here and member is not None and key is None
            depth, bracket, state = depth + opened - closed, bracket + brackets, (state + r["quotes"]) % 2
            fault = fault or depth < 0 or bracket < 0
            ends = bool(text) and closed and depth == outer
            if ends or (last and text):
                out.append((*key_of_block, n, "".join(lead), "".join(text), begins, ends, level, key, known, unknown, fault))
                lead, lead_state, text, begins, fault = [], state, [], False, False
            if last and (lead or fault):
                out.append((*key_of_block, n + 1, "".join(lead), None, False, False, bracket, key, known, unknown, fault))
            if len(out) >= ROWS_OUT or sum(len(o[4] or "") for o in out[-1:]) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PARTS)], schema=_PARTS)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PARTS)], schema=_PARTS)

    return run


def read_json_objects(spark: SparkSession, path: str, member: str | None = None) -> JsonObjects:
    """The objects of the array ``member`` of a root object; without a member those of a root array, or of JSON lines."""
    records = _records(spark, path)
    states = _block_states(records)
    if states.count() <= BROADCAST_BLOCKS:
        met = records.join(F.broadcast(states), ["path", "block"])  # keeps the order of the scan
    else:
        met = records.repartition("path", "block").join(states, ["path", "block"]).sortWithinPartitions("path", "block", "pos")
    kinds = {"string": "string", "int64": "long", "bool": "boolean"}
    parts = cut(met.drop("file_size", "bytes", "pos").mapInArrow(
        _cut_blocks(0 if member is None else 1, member), ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in _PARTS)))

    # what each block adds to the numbering, and the array that is open at its start
    begun = F.col("begins").cast("long")
    last_row = F.max_by(F.struct("key", "known", "unknown"), "n")
    blocks = parts.groupBy("path", "block").agg(F.sum(begun).alias("begun"), last_row.alias("end"), F.max("fault").alias("fault"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("carried", F.last("end.key", ignorenulls=True).over(before))
    of_member = F.col("carried").eqNullSafe(F.lit(member)) if member is not None else F.lit(False)
    blocks = blocks.withColumn("of_member", of_member)
    members = F.col("end.known") + F.when(F.col("of_member"), F.col("end.unknown")).otherwise(0)
    blocks = cut(blocks.select("path", "block", "of_member", "fault", F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("begun_before"),
                               F.coalesce(F.sum(members).over(before), F.lit(0)).alias("members_before"), members.alias("members")))
    at = parts.drop("fault").join(F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks, ["path", "block"])
    if member is None:
        inside = F.col("level") <= 1
    else:
        inside = (F.col("level") == 1) & F.when(F.col("key").isNull(), F.col("of_member")).otherwise(F.col("key") == member)
    at = at.withColumns({"number": F.col("begun_before") + F.col("n"), "is_member": F.col("begins") & inside,
                         "idx": F.col("members_before") + F.col("known") + F.when(F.col("of_member"), F.col("unknown")).otherwise(0) - 1})
    objects = at.where("text IS NOT NULL")
    whole = objects.where("begins AND ends").select("path", "number", "idx", "is_member", "lead", "text")
    # the parts of objects that cross a block's end: a few a block
    pieces = F.sort_array(F.collect_list(F.struct("block", "text")))
    first = lambda c: F.min_by(c, "block").alias(c)
    joined = objects.where("NOT (begins AND ends)").groupBy("path", "number").agg(
        first("idx"), first("is_member"), first("lead"), F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))
    every = whole.unionByName(joined.select(whole.columns))

    comma = F.rlike("lead", F.lit(r"^[ \t\r\n]*,[ \t\r\n]*$")) if member is not None else F.rlike("lead", F.lit(r"^[ \t\r\n]*,?[ \t\r\n]*$"))
    around = every.where(~F.col("is_member") | ~comma).select(
        "path", "number", F.concat("lead", F.when(F.col("is_member"), F.lit("")).otherwise(F.col("text"))).alias("text"))
    around = around.unionByName(at.where("text IS NULL").select("path", "number", F.col("lead").alias("text")))
    ordered = F.sort_array(F.collect_list(F.struct("number", "text")))
    skeletons = around.groupBy("path").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("skeleton"))
    counts = blocks.groupBy("path").agg(F.sum("members").alias("objects"), F.max("fault").alias("fault"))
    faults = states.groupBy("path").agg(F.max("file_fault").alias("file_fault"))
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))  # names only
    files = listed.join(skeletons, "path", "left").join(counts, "path", "left").join(faults, "path", "left").select(
        "path", F.coalesce("skeleton", F.lit("")).alias("skeleton"), F.coalesce("objects", F.lit(0)).alias("objects"),
        (F.coalesce("fault", F.lit(True)) | F.coalesce("file_fault", F.lit(True))).alias("fault"))
    return JsonObjects(every.where("is_member").select("path", "idx", "text"), files)
