"""Streams against their batch answer; writers and readers round trip."""

from pyspark.sql import functions as F

from artkiln.operators.lifecycle import idle_sessions, latest_jobs
from artkiln.sources import files, sinks
from artkiln.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_of(spark, df, path):
    df.repartition(3).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_job_states_stream_equals_batch(spark, tmp_path):
    """Also where changes of one time come in several batches."""
    df = events(spark).selectExpr("concat('t', user_id) task_id", "event_id", "timestamp'2024-01-01' + make_interval(0,0,0,0,cast(event_id % 3 as int)) ts", "case when event_id % 50 = 0 then 'COMPLETED' when event_id % 2 = 0 then 'FAILED' else 'PROGRESS' end state", "cast(event_id % 100 as int) progress")
    run(J.job_states(stream_of(spark, df, str(tmp_path / "in"))), "states", tmp_path, "complete")
    batch = latest_jobs(df)
    assert batch.exceptAll(spark.table("states")).isEmpty() and spark.table("states").count() == batch.count()


def test_redelivery_runs_by_state(spark, tmp_path):
    rows = [("a", 1, 0, "PENDING"), ("a", 2, 1, "COMPLETED"), ("a", 3, 200, "PENDING"), ("b", 4, 0, "PENDING"), ("b", 5, 1, "FAILED"), ("b", 6, 2, "PENDING"), ("c", 7, 3, "PENDING")]
    folder = tmp_path / "jobs"
    for i, part in enumerate((rows[:4], rows[4:6] + rows[2:3], rows[6:])):
        spark.createDataFrame(part, "task_id string, event_id bigint, m int, state string").selectExpr("task_id", "event_id", "timestamp'2024-01-01' + make_interval(0,0,0,0,0,m) ts", "state").coalesce(1).write.parquet(str(folder / f"p{i}"))
    files_ = spark.readStream.schema("task_id string, event_id bigint, ts timestamp, state string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    run(J.deliveries(files_), "delivered", tmp_path)
    got = [(r.event_id, r.run) for r in spark.table("delivered").orderBy("event_id").collect()]
    assert set(got) == {(1, True), (3, False), (4, True), (6, True), (7, True)}


def test_same_content_passes_once(spark, tmp_path):
    df = events(spark).selectExpr("user_id % 3 campaign_id", "sha2(event_type, 256) sha256", "timestamp'2024-01-01' ts")
    run(J.once_per_content(stream_of(spark, df, str(tmp_path / "in"))), "content", tmp_path)
    assert spark.table("content").count() == df.select("campaign_id", "sha256").distinct().count()


def test_closed_sessions_equal_batch(spark, tmp_path):
    df = events(spark).selectExpr("concat('p', user_id) project_id", "event_id touch_id", "ts")
    run(J.idle_expiry(stream_of(spark, df.coalesce(1), str(tmp_path / "in")), delay="40 days"), "idle", tmp_path, "append")
    batch = J.idle_expiry(df).select("project_id", "start", "end", "touches")
    mine = idle_sessions(df, "project_id").select("project_id", "start", "end", "touches")
    assert batch.exceptAll(mine).isEmpty() and mine.exceptAll(batch).isEmpty()
    assert spark.table("idle").join(batch, ["project_id", "start", "end", "touches"], "left_anti").isEmpty()


def test_daily_windows(spark, tmp_path):
    df = events(spark).selectExpr("user_id account", "ts")
    run(J.posts_per_window(stream_of(spark, df, str(tmp_path / "in")), "account", delay="60 days"), "days", tmp_path, "complete")
    batch = J.posts_per_window(df, "account")
    assert batch.exceptAll(spark.table("days")).isEmpty()
    assert J.posts_per_window(df, "account", "30 days", "1 day").count() > batch.count()


def test_folder_watch_and_inventory(spark, tmp_path):
    for name in ("a.png", "b/c.psd", "b/.x.png", "b/c/d/e.png", "n.txt"):
        p = tmp_path / "drop" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"1234")
    assert [r.rel for r in files.list_folder(spark, str(tmp_path / "drop")).collect()] == ["a.png", "b/c.psd"]
    run(J.watch_folder(spark, str(tmp_path / "drop")).select("path", "length"), "drop", tmp_path)
    assert spark.table("drop").where("path like '%a.png'").count() == 1


def test_pictures_of_a_folder_and_their_sizes(spark, tmp_path):
    """Heads of every format, cut ones, a broken one, an empty one; the first few and a note."""
    be, le = (lambda n, k: n.to_bytes(k, "big")), (lambda n, k: n.to_bytes(k, "little"))
    exif = b"\xff\xe1" + be(60_002, 2) + b"\xff\xc0" * 30_000
    tiff = b"II*\0" + le(400_000, 4) + b"\0" * 399_992 + le(2, 2) + le(256, 2) + le(3, 2) + le(1, 4) + le(70, 4) + le(257, 2) + le(4, 2) + le(1, 4) + le(80, 4)
    heads = {
        "a.png": (b"\x89PNG\r\n\x1a\n" + be(13, 4) + b"IHDR" + be(31, 4) + be(41, 4), "PNG", 31, 41),
        "b.jpg": (b"\xff\xd8" + exif + exif + b"\xff\xff\xc2" + be(17, 2) + b"\x08" + be(42, 2) + be(32, 2) + b"\3\1\2", "JPEG", 32, 42),
        "c/d.psd": (b"8BPS\0\1" + b"\0" * 6 + be(4, 2) + be(43, 4) + be(33, 4), "PSD", 33, 43),
        "e.webp": (b"RIFF" + le(30, 4) + b"WEBPVP8X" + le(10, 4) + b"\0" * 4 + le(33, 3) + le(43, 3), "WEBP", 34, 44),
        "f.webp": (b"RIFF" + le(30, 4) + b"WEBPVP8L" + le(10, 4) + b"\x2f" + le(34 | 44 << 14, 4), "WEBP", 35, 45),
        "g.webp": (b"RIFF" + le(30, 4) + b"WEBPVP8 " + le(10, 4) + b"\0\0\0\x9d\1\x2a" + le(36, 2) + le(46, 2), "WEBP", 36, 46),
        "h.tif": (tiff, "TIFF", 70, 80),
        "i.avif": (be(28, 4) + b"ftypavif" + b"\0" * 40 + b"ispe\0\0\0\0" + be(37, 4) + be(47, 4), "AVIF", 37, 47),
    }
    bad = {"k.png": b"\x89PNG\r\n\x1a\n\0\0", "l.jpg": b"\xff\xd8\xff", "m.tif": tiff[:4000], "n.psd": b"", "o.png": b"<svg/>", "p.jpg": b"\xff\xd8" + exif[:100]}
    for name, content in [*((n, h[0]) for n, h in heads.items()), *bad.items(), ("q.txt", b"1"), (".r.png", b"1")]:
        (tmp_path / "art" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "art" / name).write_bytes(content)
    got = {r.rel: r for r in files.inspect_folder(spark, str(tmp_path / "art")).collect()}
    assert "n.psd" not in got  # an empty file is not listed
    got["n.psd"] = files.inspect(spark.createDataFrame([("n.psd", 0, b"")], "rel string, length long, content binary")).first()
    del bad["n.psd"]
    assert got.pop("n.psd").warning == "n.psd: no se pudo leer (UnidentifiedImageError)."
    assert {n: (r.format, r.width, r.height, r.warning) for n, r in got.items()} == {
        **{n: (*h[1:], None) for n, h in heads.items()}, **{n: (None, None, None, n + ": no se pudo leer (UnidentifiedImageError).") for n in bad}}
    few = files.inspect_folder(spark, str(tmp_path / "art"), most=3).collect()
    assert [r.rel for r in few if r.warning is None] == ["a.png", "b.jpg", "c/d.psd"] and len(few) == 3 + len(bad) + 1
    assert [r.warning for r in few if r.rel is None] == ["Se listan solo los primeros 3 archivos."]
    assert files.inspect_folder(spark, str(tmp_path / "art"), most=8).count() == 8 + len(bad)


def test_manifest_and_matrix_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 'TV "55"', "Base", "feed", 1, "ready", "a.png", "a.jpg", "a.psd", ["uno", "dos"], "b1")],
                               "row_number int, product string, template_name string, format_id string, proposal int, status string, png string, jpg string, psd string, warnings array<string>, batch string")
    sinks.write_manifest(df, str(tmp_path / "m"))
    r = spark.read.csv(str(tmp_path / "m"), header=True, escape="\\").first()
    assert r.avisos == "uno | dos" and r.formato == "feed"
    sinks.write_manifest(df, str(tmp_path / "p"), ["batch"])
    assert (tmp_path / "p" / "batch=b1").exists()
    sinks.write_documents(df, str(tmp_path / "j"), ["batch"])
    back = files.read_records(spark, str(tmp_path / "j"), "row_number INT, product STRING").first()
    assert back.product == 'TV "55"'


def test_corrupt_records_and_tenants(spark, tmp_path):
    folder = tmp_path / "t" / "client_id=a" / "campaign_id=k"
    folder.mkdir(parents=True)
    (folder / "1.json").write_text('{"doc_client":"a","state":"DONE","n":1}\n{"doc_client":"b","state":"DONE","n":2}\n{"doc_client":"a","state":"PENDING","n":3}\n')
    df = files.read_partitioned(spark, str(tmp_path / "t"), "state STRING, n INT", ["DONE"])
    assert [r.n for r in df.collect()] == [1]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"n": 1}\n{"n": \n{"n": 3}\n')
    assert sorted(r.n for r in files.read_records(spark, str(tmp_path / "r"), "n INT").collect()) == [1, 3]


def test_documents_refuse_nul(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("hola  mundo\n\n\n\nfin ".encode())
    (tmp_path / "b.txt").write_bytes(b"ab\x00cd")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "hola mundo\n\nfin", "b.txt": None}


def png(w, h, rgb):
    import struct
    import zlib

    def chunk(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))

    raw = b"".join(b"\x00" + b"".join(bytes(rgb(x, y)) for x in range(w)) for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pixels_of_a_picture(spark, tmp_path):
    from artkiln.sources.pixels import read_pixels

    (tmp_path / "x.png").write_bytes(png(5, 4, lambda x, y: (x * 10, y * 20, 7)))
    px = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in read_pixels(spark, str(tmp_path)).collect()}
    assert len(px) == 20 and px[(3, 2)] == (30, 40, 7, 255)


def test_strips_of_a_picture_equal_its_pixels(spark, tmp_path):
    from artkiln.operators import images as I
    from artkiln.sources import pixels as X

    (tmp_path / "x.png").write_bytes(png(53, 41, lambda x, y: (x * 4, y * 6 % 256, (x * y) % 256)))
    (tmp_path / "y.png").write_bytes(png(17, 90, lambda x, y: ((x + y) % 256, 9, 9)))
    px, images = X.read_pixels(spark, str(tmp_path)), spark.read.format("image").load(str(tmp_path))
    raw = images.selectExpr("regexp_extract(image.origin, '([^/]+)$', 1) image_id", "image.width w", "image.height h", "image.nChannels c", "image.data data")
    assert X.image_strips(spark, str(tmp_path)).count() == 2
    cut = X.strips(raw, strip_bytes=700)
    assert cut.count() > 10
    colours = px.groupBy("image_id", "r", "g", "b", "a").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, X.colour_counts(cut).collect())) == sorted(map(tuple, colours.collect()))
    sums = X.strip_sums(cut)
    mine = I.signatures_of_sums(X.picture_sums(sums), X.picture_cells(sums), ["image_id"])
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, I.signatures(px, ["image_id"]).collect()))
    assert sorted(map(tuple, X.picture_sums(sums).select("image_id", "x", "y", "width", "height").collect())) == [("x.png", 0, 0, 53, 41), ("y.png", 0, 0, 17, 90)]


def test_a_large_picture_needs_no_row_per_pixel(spark):
    from artkiln.sources import pixels as X

    row = bytes(range(256)) * 72  # 6,144 pixels of three channels
    d = spark.createDataFrame([("big", 6144, 4400, 3, row * 4400)], "image_id string, w int, h int, c int, data binary")
    cut = X.strips(d)
    assert cut.count() < 100
    whole = X.picture_sums(X.strip_sums(cut)).first()
    assert whole.n == 6144 * 4400 and (whole.width, whole.height) == (6144, 4400)
    assert whole.sum_b + whole.sum_g + whole.sum_r == 4400 * sum(row)


def test_user_detector(spark):
    from artkiln.operators.plugins import detect_with

    def detector(batch):
        import pandas as pd

        return pd.DataFrame({"image_id": batch["image_id"], "ord": 1, "x": 0, "y": 0, "width": 9, "height": 9, "score": 0.5, "label": "x", "kind": "region"})

    assert detect_with(spark.createDataFrame([("a",), ("b",)], "image_id string"), detector).count() == 2


def test_a_failing_write_leaves_the_committed_records(spark, tmp_path):
    from artkiln.sources import store

    path, schema = str(tmp_path / "store"), "id BIGINT, state STRING"
    assert store.read_store(spark, path, schema).count() == 0
    rows = spark.createDataFrame([(1, "x", "a", 7, "a"), (2, "y", "a", 8, "a"), (3, "x", "b", 7, "z")], "id long, state string, client_id string, campaign_id long, doc_client string")
    store.replace_records(rows, path)
    broken = rows.withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("id") + 10).cast("long"))
    try:
        store.replace_records(broken, path)
        raise AssertionError("the write should fail")
    except Exception as e:  # noqa: BLE001
        assert "no" in str(e)
    kept = store.read_store(spark, path, schema)
    assert sorted(r.id for r in kept.collect()) == [1, 2]  # record 3 names another tenant than its folder
    one = store.read_store(spark, path, schema, ["x"]).where("client_id = 'a' AND campaign_id = '7'")
    assert [r.id for r in one.collect()] == [1] and "PartitionFilters: [isnotnull(client_id" in one._jdf.queryExecution().toString()
    store.replace_records(rows.where("id = 2"), path)
    assert [r.id for r in store.read_store(spark, path, schema).collect()] == [2]


def test_completions_are_forgotten_after_their_time(spark, tmp_path):
    """In one batch or in several."""
    rows = [("a", 1, 0, "PENDING"), ("a", 2, 1, "COMPLETED"), ("a", 3, 30, "PENDING"), ("a", 4, 80, "PENDING"), ("b", 5, 400, "PENDING"), ("a", 6, 401, "COMPLETED"), ("a", 7, 402, "PENDING"), ("b", 8, 900, "PENDING")]
    for n in (8, 1):
        folder = tmp_path / f"jobs{n}"
        for i in range(0, 8, n):
            spark.createDataFrame(rows[i : i + n], "task_id string, event_id bigint, m int, state string").selectExpr("task_id", "event_id", "timestamp'2024-01-01' + make_interval(0,0,0,0,0,m) ts", "state").coalesce(1).write.parquet(str(folder / f"p{i}"))
        files_ = spark.readStream.schema("task_id string, event_id bigint, ts timestamp, state string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
        run(J.deliveries(files_, hours=1), f"ttl{n}", tmp_path)
        assert {(r.event_id, r.run) for r in spark.table(f"ttl{n}").collect()} == {(1, True), (3, False), (4, True), (5, True), (7, False), (8, True)}
