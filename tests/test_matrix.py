"""The matrix contract on small hand-written files."""

import pytest
from pyspark.sql import functions as F

from artkiln.functions import text as X
from artkiln.operators import matrix as M
from artkiln.sources import matrix_files as MF


def read(spark, tmp_path, *files):
    for name, body in files:
        (tmp_path / name).write_bytes(body if isinstance(body, bytes) else body.encode("utf-8"))
    rows, errors = MF.read_matrices(spark, str(tmp_path))
    name = F.regexp_extract("matrix_id", r"([^/]+)$", 1)
    return (rows.withColumn("matrix_id", name).orderBy("matrix_id", "row_number").collect(),
            errors.withColumn("matrix_id", name).orderBy("matrix_id", "row_number").collect())


def test_comma_file_with_quoted_separator(spark, tmp_path):
    rows, errors = read(spark, tmp_path, ("a.csv", 'producto,imagen,titular,precio,cta,formatos,cantidad_propuestas\nTV 55,tv.png,"Grande, brillante y conectado",499,"Compra, disfruta","feed;story",2\n'))
    assert not errors
    r = rows[0]
    assert (r.row_number, r.producto, r.titular, r.precio_actual, r.cta, r.formatos, r.cantidad_propuestas) == (
        2, "TV 55", "Grande, brillante y conectado", "499", "Compra, disfruta", ["feed", "story"], 2)


def test_semicolons_and_repeated_formats(spark, tmp_path):
    rows, _ = read(spark, tmp_path, ("a.csv", "producto;imagen;subtitulo;formatos;propuestas\nLaptop;laptop.png;Potencia para crear;1080x1080|1080x1920|1080x1080;3\n"))
    assert rows[0].formatos == ["1080x1080", "1080x1920"] and rows[0].cantidad_propuestas == 3


def test_suppressed_is_not_empty(spark, tmp_path):
    rows, _ = read(spark, tmp_path, ("a.csv", "producto,imagen,titular,subtitulo,precio,cta,legal\nRefrigeradora,refri.png,,no poner,799,omitir,\n"))
    r = rows[0]
    assert r.titular is None and r.subtitulo is None and r.suppressed_fields == ["subtitulo", "cta"]


@pytest.mark.parametrize("bad", ["0", "7", "dos", "1.5"])
def test_bad_quantity_is_an_error_row(spark, tmp_path, bad):
    rows, errors = read(spark, tmp_path, ("a.csv", f"producto,cantidad\nTV,{bad}\nOtro,2\n"))
    assert [r.row_number for r in rows] == [3] and [(e.row_number, e.rule) for e in errors] == [(2, "quantity")]


def test_english_headers_encodings_and_record_numbers(spark, tmp_path):
    head = "SKU,file,headline,old_price,current_price,installments,discount,terms,validity,template,count"
    utf16 = ("﻿" + head + "\n,,,,,,,,,,\nTV,tv.png,Hola,50,40,12x,20%,Aplica,Hoy,Combo,2\n").encode("utf-16-le")
    latin = "producto,titular\nTV,Año nuevo\n".encode("latin-1")
    rows, errors = read(spark, tmp_path, ("a.csv", utf16), ("b.csv", latin), ("c.csv", "x,y\n1,2\n"), ("d.pdf", "z"))
    assert (rows[0].row_number, rows[0].plantilla, rows[0].descuento) == (3, "Combo", "20%")
    assert rows[1].titular == "Año nuevo"
    assert {(e.matrix_id, e.rule) for e in errors} == {("c.csv", "no_known_header"), ("d.pdf", "unknown_extension")}


def test_individual_row_expands_with_free_numbers(spark):
    base = spark.createDataFrame(
        [("m", 2, "Licuadora |", "lic.png|air-fryer_oster.png|tv.png", "$40 | $90 | $500", "individual", ["feed", "story"], 1),
         ("m", 3, "Otro", None, "9", "combo", [], 1)],
        "matrix_id string, row_number int, producto string, imagen string, precio_actual string, modo string, formatos array<string>, cantidad_propuestas int")
    rows = base.withColumns({c: F.lit(None).cast("string") for c in ("precio_anterior", "cuota", "descuento")}).withColumn("fila_origen", F.lit(None).cast("int"))
    out = M.expand_rows(rows).orderBy("row_number").collect()
    assert [(r.row_number, r.producto, r.imagen, r.precio_actual, r.fila_origen) for r in out] == [
        (2, "Licuadora", "lic.png", "$40", 2), (3, "Otro", None, "9", None), (4, "Air fryer oster", "air-fryer_oster.png", "$90", 2), (5, "Tv", "tv.png", "$500", 2)]
    assert M.requested_pieces(M.expand_rows(rows), ["matrix_id"]).first().pieces == 7


def test_expansion_is_the_same_for_any_block_size(spark):
    rows = spark.range(200).selectExpr(
        "'m' matrix_id", "cast(id + 2 as int) row_number", "concat('a', id, '|b') producto", "cast(null as string) imagen",
        "case when id % 3 = 0 then 'individual' else 'combo' end modo", "cast(null as int) fila_origen", *[f"cast(null as string) {c}" for c in ("precio_actual", "precio_anterior", "cuota", "descuento")])
    one, many = (sorted(map(tuple, M.expand_rows(rows, block=b).collect()), key=str) for b in (10_000, 7))
    assert one == many and len({r[1] for r in one}) == len(one)


def test_slug_and_display_name(spark):
    d = spark.createDataFrame([("  Año_NUEVO--Straße ñ ", "licuadora-oster_2L.png")], "a string, b string")
    r = d.select(X.slug(F.col("a")).alias("s"), X.display_name(F.col("b")).alias("n")).first()
    assert (r.s, r.n) == ("ano_nuevo_strasse_n", "Licuadora oster 2L")


def test_cells_are_read_by_one_pattern_like_by_slugs_and_parts(spark):
    """ASCII cells and others, with white space and separators at odd places."""
    import random
    import re

    from pyspark.sql import functions as F

    from artkiln import constants as K
    from artkiln.functions import text as X

    rnd = random.Random(16)
    pieces = ["no", "poner", "Omitir", "SÍ", "si", "sin", "contenido", " ", "_", "-", "|", ";", "\n", "\t", "\u00a0", "\u0085", "é", "ß", "uno", "por", "producto", "1", "a.png", "\x1c", "A", "a"]
    cells = [None, "", "no_poner", " No  Poner!", "NO\nPONER\n", "nó poner", "no poner 2", "nopner", "a | b ; c", " | ;", "x", "Foto|foto; FOTO"]
    cells += ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 9))) for _ in range(600)]
    c = F.col("c")
    rows = spark.createDataFrame([(x,) for x in cells], "c string").select(
        "c", X.slug_in(c, K.SUPPRESS_TOKENS).alias("off"), X.slug(c).isin(*K.SUPPRESS_TOKENS).alias("off_slug"), X.slug_in(c, K.INDIVIDUAL_TOKENS).alias("one"),
        X.slug(c).isin(*K.INDIVIDUAL_TOKENS).alias("one_slug"), X.list_cell(c).alias("parts"), X.list_size(c).alias("n"), X.distinct_folded(X.list_cell(c)).alias("kept")).collect()
    blank = " \t\n\x0b\f\r"
    for r in rows:
        assert (r.off, r.one) == (r.off_slug, r.one_slug), r.c
        plain = [p.strip(blank) for p in re.split("[|;]", r.c or "")]
        assert r.n == len([p for p in plain if p]) == len(r.parts), r.c
        if "\u0085" not in (r.c or ""):  # a line end that the trimming pattern knows apart
            assert r.parts == [p for p in plain if p], r.c
        folded = [p.lower().replace("ß", "ss") for p in r.parts]
        assert r.kept == [p for i, p in enumerate(r.parts) if folded.index(folded[i]) == i], r.c
    assert sum(r.off for r in rows) > 5 and sum(r.one for r in rows) > 5


def test_lists_of_a_written_row_are_read_before_it_is_split(spark):
    cols = "matrix_id string, row_number int, producto string, imagen string, precio_actual string, precio_anterior string, cuota string, descuento string, modo string, fila_origen int"
    rows = spark.createDataFrame([("m", 2, "a | b ;c", " x.png|y_1.png", "$1|$2", "$9", None, "", "individual", None), ("m", 3, " | ", "z.png", "1|2", "", "", "", "individual", None),
                                  ("m", 4, "a|b", None, "1|2", "", "", "", "combo", None)], cols)
    out = M.expand_rows(rows)
    got = {tuple(r)[1:5] + (r.fila_origen,) for r in out.collect()}
    assert got == {(2, "a", "x.png", "$1", 2), (5, "b", "y_1.png", "$2", 2), (6, "c", None, None, 2), (3, " | ", "z.png", "1|2", None), (4, "a|b", None, "1|2", None)}
    # Before, six cells were split again for each product.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan[plan.index("Generate"):] and "regexp_extract_all" not in plan[:plan.index("Generate")]
