"""Problem 2: load CSV deliveries, valid rows as typed columns, failing rows with their reason.

Records are structured by pyarrow's CSV reader inside Arrow batches: its invalid-row callback yields the rows
of wrong width, fields come back as string vectors. Whether a record kept the quoting rules shows by
writing its fields again and comparing with the record; the cells are then cast and tested as vectors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.session import text_batches

TICKETS = ("id_ticket", "fecha_apertura", "fecha_cierre", "cliente", "prioridad", "categoria", "descripcion_breve", "tecnico_asignado", "estado")
EQUIPMENT = ("id_equipo", "tipo", "marca", "modelo", "numero_serie", "asignado_a", "departamento", "fecha_compra", "estado")
LAYOUTS = {"tickets": TICKETS, "equipment": EQUIPMENT}
_BLANKS = " \t\r\n"
#: Line breaks inside records stand as these while a batch is one CSV text; the guard is a value that no record holds.
_LF, _CR, _GUARD = "\U000F0000", "\U000F0001", "\U000F0002"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _dates(v: pa.Array, empty_ok: bool) -> pa.Array:
    """Which cells are real dates: cast, and the same when written again."""
    day = pc.strptime(v, "%Y-%m-%d", "s", error_is_null=True)
    real = pc.and_(pc.match_substring_regex(v, _DATE), pc.fill_null(pc.equal(pc.strftime(day, "%Y-%m-%d"), v), False))
    return pc.or_(real, pc.equal(v, "")) if empty_ok else real


def _checks(layout: str, t: dict[str, pa.Array]) -> list[tuple[str, pa.Array]]:
    """(column, cells that are right) in the order in which failures are reported."""
    m = pc.match_substring_regex
    if layout == "tickets":
        return [
            ("id_ticket", m(t["id_ticket"], r"^TK-[0-9]{4}-[0-9]{4,}$")), ("fecha_apertura", _dates(t["fecha_apertura"], False)),
            ("fecha_cierre", _dates(t["fecha_cierre"], True)), ("descripcion_breve", pc.not_equal(t["descripcion_breve"], "")),
        ]
    serial = t["numero_serie"]
    return [
        ("id_equipo", m(t["id_equipo"], r"^EQ-[0-9]{4,}$")), ("numero_serie", pc.and_(m(serial, r"^[A-Z0-9-]{5,20}$"), m(serial, "[0-9]"))),
        ("fecha_compra", _dates(t["fecha_compra"], True)),
    ]


def _read(records: pa.Array, sep: str, width: int) -> tuple[list[pa.Array], np.ndarray, np.ndarray, dict[int, int]]:
    """(field vectors, the records they belong to, records with an open quote, {record of wrong width: its width}).

    After each record stands a guard line that is a row of the same width. Where a value is left open, the guard's
    first quote closes it, so that a record never reaches into the next one: the two become one row.
    """
    lines = pc.binary_join_element_wise(records, f'"{_GUARD}"' + sep * (width - 1) + "\n", "\n")
    body = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "")[0].as_buffer()
    names = [str(i) for i in range(width)]
    wrong: list[tuple[int, int, bool]] = []

    def invalid(row: csv.InvalidRow) -> str:
        wrong.append((row.number - 1, row.actual_columns, "\n" in row.text))  # rows are numbered from 1 in a read without threads
        return "skip"

    table = csv.read_csv(
        pa.BufferReader(body), csv.ReadOptions(use_threads=False, column_names=names, block_size=body.size + 2),
        csv.ParseOptions(delimiter=sep, invalid_row_handler=invalid, ignore_empty_lines=False),
        csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False))
    fields = [table[c].combine_chunks() for c in names]
    n = table.num_rows + len(wrong)
    at_wrong = np.array([w[0] for w in wrong], np.int64)
    is_table = np.ones(n, bool)
    is_table[at_wrong] = False
    ends, open_ = np.zeros(n, bool), np.zeros(n, bool)  # rows that end a record: guards, and records grown together with theirs
    guard = pc.equal(fields[0], _GUARD)
    grown = pa.array(np.zeros(table.num_rows, bool))
    for f in fields:
        grown = pc.or_(grown, pc.match_substring(f, "\n"))
    ends[is_table] = pc.or_(guard, grown).to_numpy(zero_copy_only=False)
    open_[is_table] = grown.to_numpy(zero_copy_only=False)
    open_[at_wrong] = [w[2] for w in wrong]
    ends |= open_
    record = np.cumsum(ends) - ends
    plain = ~pc.or_(guard, grown).to_numpy(zero_copy_only=False)
    keep = pa.array(plain)
    return [f.filter(keep) for f in fields], record[is_table][plain], record[open_], {int(record[i]): w for i, w, grew in wrong if not grew}


def _well_quoted(records: pa.Array, fields: list[pa.Array], sep: str) -> np.ndarray:
    """Which records are what their fields look like when written: bare without any quote, or quoted with quotes doubled, as the record's own byte at that place says."""
    at = np.frombuffer(records.buffers()[1], np.int32)[records.offset : records.offset + len(records) + 1].astype(np.int64)
    data = np.frombuffer(records.buffers()[2] or b"\0", np.uint8)
    place, last = at[:-1].copy(), max(len(data) - 1, 0)
    bare_quote = np.zeros(len(records), bool)
    pieces = []
    for f in fields:
        quoted = data[np.minimum(place, last)] == ord('"')
        quoted &= place < at[1:]
        quotes = pc.count_substring(f, '"').to_numpy()
        bare_quote |= ~quoted & (quotes > 0)
        pieces.append(pc.if_else(pa.array(quoted), pc.binary_join_element_wise('"', pc.replace_substring(f, '"', '""'), '"', ""), f))
        place += pc.binary_length(pieces[-1]).to_numpy() + 1
    same = pc.equal(pc.binary_join_element_wise(*pieces, sep), records).to_numpy(zero_copy_only=False)
    return same & ~bare_quote


def parse_records(raw: pa.Array, sep: str, layout: str) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(reason, bad column, fields) of each record; reason null for valid ones, fields null where there are no nine."""
    n, names = len(raw), LAYOUTS[layout]
    empty = pc.equal(raw, "").to_numpy(zero_copy_only=False)  # one empty value; the CSV reader takes an empty line for a row of nulls
    records = pc.replace_substring(pc.replace_substring(raw, "\n", _LF), "\r", _CR)
    reason, column = np.full(n, None, object), np.full(n, None, object)
    reason[empty] = "column_count"
    todo = np.flatnonzero(~empty)
    if not len(todo):
        return pa.array(reason, pa.string()), pa.array(column, pa.string()), pa.nulls(n, pa.list_(pa.string()))
    part = records.take(pa.array(todo))
    fields, mine, open_, wrong = _read(part, sep, len(names))
    reason[todo[open_]] = "broken_quote"
    by_width: dict[int, list[int]] = defaultdict(list)
    for i, width in wrong.items():
        by_width[width].append(i)
    for width, rows in by_width.items():  # records of wrong width, read once more at their own
        theirs = part.take(pa.array(rows))
        f, which, _, _ = _read(theirs, sep, width)
        ok = np.zeros(len(rows), bool)
        ok[which] = _well_quoted(theirs.take(pa.array(which)), f, sep)
        reason[todo[rows]] = np.where(ok, "column_count", "broken_quote")
    good = _well_quoted(part.take(pa.array(mine)), fields, sep)
    reason[todo[mine[~good]]] = "broken_quote"
    keep, at = pa.array(good), todo[mine[good]]
    cells = {c: pc.utf8_trim(pc.replace_substring(pc.replace_substring(f.filter(keep), _LF, "\n"), _CR, "\r"), _BLANKS) for c, f in zip(names, fields)}
    for c, ok in _checks(layout, cells):
        bad = at[~ok.to_numpy(zero_copy_only=False)]
        bad = bad[reason[bad] == None]  # noqa: E711 - elementwise
        reason[bad], column[bad] = "invalid_value", c
    # Nine cells side by side as one list for each record.
    k = len(at)
    flat = pa.concat_arrays(list(cells.values())).take(pa.array((np.arange(k)[:, None] + k * np.arange(len(names))[None, :]).ravel()))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * len(names)), flat)
    place = np.full(n, -1)
    place[at] = np.arange(k)
    return pa.array(reason, pa.string()), pa.array(column, pa.string()), lists.take(pa.array(np.where(place < 0, 0, place), mask=place < 0))


def _headers(records: DataFrame) -> DataFrame:
    """(file_name, sep, layout) from line 1 of each file, once however often it was delivered."""
    first = records.filter("line_no = 1").groupBy("file_name").agg(F.min("raw_record").alias("h"))
    commas, semis = (F.char_length("h") - F.char_length(F.replace("h", F.lit(x), F.lit(""))) for x in (",", ";"))
    return first.select("file_name", F.when(semis > commas, ";").otherwise(",").alias("sep"), F.when(F.contains("h", F.lit("id_equipo")), "equipment").otherwise("tickets").alias("layout"))


def load_records(records: DataFrame) -> DataFrame:
    """Records (record_id, file_name, line_no, raw_record) with layout, reason, bad_column and fields.

    Line 1 of each file is its header and is left out. reason is null for valid rows, else the first that
    applies of broken_quote, column_count, invalid_value; for the last, bad_column names the first failing
    cell. fields holds the nine trimmed values wherever a record has nine. A file without a header is taken
    as comma-separated tickets unless the record starts like equipment. A null record has no columns. Each
    delivery of a repeated record is judged by itself. An empty table gives no rows.
    """
    text_batches(records.sparkSession)
    rows = records.select("record_id", "file_name", "line_no", "raw_record")
    body = rows.filter("line_no is null or line_no != 1").join(_headers(rows), "file_name", "left")
    body = body.withColumn("raw", F.coalesce("raw_record", F.lit("")))
    body = body.withColumn("raw", F.when(F.endswith("raw", F.lit("\r")), F.expr("left(raw, char_length(raw) - 1)")).otherwise(F.col("raw")))
    body = body.withColumn("layout", F.coalesce("layout", F.when(F.col("raw").rlike('^"?EQ-'), "equipment").otherwise("tickets"))).withColumn("sep", F.coalesce("sep", F.lit(",")))

    names = ["record_id", "file_name", "line_no", "layout", "reason", "bad_column", "fields"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind in pc.unique(pc.binary_join_element_wise(b["sep"], b["layout"], "")).to_pylist():
                sep, layout = kind[0], kind[1:]
                part = b.filter(pc.and_(pc.equal(b["sep"], sep), pc.equal(b["layout"], layout)))
                yield pa.RecordBatch.from_arrays([part["record_id"], part["file_name"], part["line_no"], part["layout"], *parse_records(part["raw"].cast(pa.string()), sep, layout)], names)

    return body.select("record_id", "file_name", "line_no", "raw", "sep", "layout").mapInArrow(
        run, "record_id long, file_name string, line_no int, layout string, reason string, bad_column string, fields array<string>")


def typed_rows(loaded: DataFrame, layout: str) -> DataFrame:
    """The valid rows of one layout as typed columns; empty values become null, fecha_* dates."""
    names = LAYOUTS[layout]
    cell = lambda i: F.nullif(F.element_at("fields", i + 1), F.lit(""))
    return loaded.filter((F.col("layout") == layout) & F.col("reason").isNull()).select(
        "record_id", *((F.try_to_date(cell(i), "yyyy-MM-dd") if c.startswith("fecha") else cell(i)).alias(c) for i, c in enumerate(names)))


def rejected_rows(loaded: DataFrame) -> DataFrame:
    """(record_id, file_name, line_no, layout, reason, bad_column) of the records that were not loaded."""
    return loaded.filter("reason is not null").drop("fields")
