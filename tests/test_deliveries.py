"""Rejects of CSV deliveries: each reason, and the cases at the edges."""

from legajo.sources import deliveries as D

H = ",".join(D.TICKETS)
E = ";".join(D.EQUIPMENT)
OK = "TK-2024-0001,2024-10-01,,Cliente S.A.,alta,red,Fallo,Ana,resuelto"
EQ = "EQ-0001;tablet;M;M1;SN-2020-1;Ana;IT;2020-02-29;activo"


def load(spark, records):
    df = spark.createDataFrame(records, "record_id long, file_name string, line_no int, raw_record string")
    return {r["record_id"]: r for r in D.load_records(df).collect()}


def test_reasons(spark):
    cases = [
        (OK, None, None), (OK + "\r", None, None), (OK.replace("Fallo", '"Fallo, ""grave"""'), None, None), (OK.replace("Fallo", '"dos\nlineas"'), None, None), (OK.replace("Fallo", "  Fallo "), None, None),
        (OK.replace("Fallo", '"Fallo'), "broken_quote", None), (OK.replace("Fallo", '"Fallo" x'), "broken_quote", None), (OK.replace("Fallo", 'pantalla 19"'), "broken_quote", None), (OK.replace("Fallo", ' "Fallo"'), "broken_quote", None),
        (OK + ",x", "column_count", None), ("a,b", "column_count", None), ("", "column_count", None), (None, "column_count", None), ("\r", "column_count", None),
        (OK.replace("TK-2024", "TK-24"), "invalid_value", "id_ticket"), (OK.replace("2024-10-01", "2024-02-30"), "invalid_value", "fecha_apertura"), (OK.replace("2024-10-01,", ","), "invalid_value", "fecha_apertura"),
        (OK.replace("Fallo", "   "), "invalid_value", "descripcion_breve"), (OK.replace(",,", ",01/02/2024,"), "invalid_value", "fecha_cierre"), (OK.replace("2024-10-01", "2024-1-1"), "invalid_value", "fecha_apertura"),
        (OK.replace("Fallo", '"x'), "broken_quote", None),
    ]
    got = load(spark, [(0, "t.csv", 1, "﻿" + H)] + [(i + 1, "t.csv", i + 2, c[0]) for i, c in enumerate(cases)])
    assert 0 not in got and len(got) == len(cases)
    for i, (raw, reason, column) in enumerate(cases):
        assert (got[i + 1]["reason"], got[i + 1]["bad_column"]) == (reason, column), raw


def test_equipment_and_separator(spark):
    got = load(spark, [(0, "e.csv", 1, E + "\r"), (1, "e.csv", 2, EQ), (2, "e.csv", 3, EQ.replace("SN-2020-1", "sn1")), (3, "e.csv", 4, EQ.replace("SN-2020-1", "ABCDE")), (4, "e.csv", 5, EQ.replace("2020-02-29", "2021-02-29")), (5, "e.csv", 6, EQ.replace("Ana", "Ana, B")), (6, "e.csv", 6, EQ)])
    assert [got[i]["reason"] for i in range(1, 7)] == [None, "invalid_value", "invalid_value", "invalid_value", None, None]
    assert got[2]["bad_column"] == "numero_serie" and got[4]["bad_column"] == "fecha_compra"


def test_no_header_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "x", 2, OK, "a"), (1, "x", 2, OK, "b"), (2, None, None, EQ.replace(";", ","), "c")], "record_id long, file_name string, line_no int, raw_record string, sep string")
    rows = D.load_records(df).collect()
    assert len(rows) == 3 and all(r["reason"] is None for r in rows)
    typed = D.typed_rows(D.load_records(df), "tickets").collect()
    assert len(typed) == 2 and typed[0]["fecha_cierre"] is None and str(typed[0]["fecha_apertura"]) == "2024-10-01"
    assert D.typed_rows(D.load_records(df), "equipment").count() == 1


def test_empty(spark):
    df = spark.createDataFrame([], "record_id long, file_name string, line_no int, raw_record string")
    assert D.load_records(df).count() == 0 and D.rejected_rows(D.load_records(df)).count() == 0


def test_quoting_against_a_scanner(spark):
    """Random records of quotes, separators, breaks and letters: the vectors agree with a scanner that goes through each record letter by letter."""
    import random

    import pyarrow as pa

    def scan(raw, sep):
        i, n = 0, 0
        while True:
            if raw[i : i + 1] == '"':
                i += 1
                while True:
                    j = raw.find('"', i)
                    if j < 0:
                        return "broken_quote"
                    if raw[j + 1 : j + 2] == '"':
                        i = j + 2
                    else:
                        i = j + 1
                        break
            else:
                j = i
                while j < len(raw) and raw[j] != sep:
                    if raw[j] == '"':
                        return "broken_quote"
                    j += 1
                i = j
            n += 1
            if i == len(raw):
                return "column_count" if n != 9 else None
            if raw[i] != sep:
                return "broken_quote"
            i += 1

    r = random.Random(7)
    for sep in ",;":
        values = ["", "a", '"a"', '""', '"x""y"', '"' + sep + '"', '"\n"', "b\r", '"open', 'mid"dle', '"a" b', '"a"b"', '""""', '"""', "ñ", '"é\n""']
        records = ["", '"', sep * 8]
        for _ in range(3000):
            records.append(sep.join(r.choice(values) for _ in range(9 if r.random() < 0.7 else r.randint(1, 12))))
        got = D.parse_records(pa.array(records), sep, "tickets")[0].to_pylist()
        want = [scan(x, sep) for x in records]
        assert [g if g != "invalid_value" else None for g in got] == want
        assert {"broken_quote", "column_count", None} == set(want)
