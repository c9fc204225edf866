"""Snapshot refresh streams: newest snapshot wins, empty/broken snapshots keep the
table, failures are recorded and the next trigger still runs."""

from pyspark.sql import functions as F

from ledgerflow.session import scratch_path
from ledgerflow.sources import store
from ledgerflow.sources import xml as X
from ledgerflow.streaming import refresh as RF
from tests.conftest import SMOKE


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_refresh_takes_newest_snapshot_and_survives_bad_ones(spark):
    drop = store.snapshot_drop_folder(spark, SMOKE, "ledger")
    full = X.scan_ledger_xml(spark, f"{drop}/snap=0002")
    older = X.scan_ledger_xml(spark, f"{drop}/snap=0001")
    assert older.count() == full.count() and not set(_rows(older)) & set(_rows(full))

    table = scratch_path(spark, "t-ledger-table")
    got = RF.refresh_once(spark, "ledger", drop, table)
    assert _rows(got) == _rows(full)

    # a later drop whose only record is broken: quarantined, table unchanged
    bad_drop = scratch_path(spark, "t-ledger-bad")
    spark.createDataFrame([("<LEDGER><NAME>x & </LEDGER>",)], "value string") \
        .write.text(f"{bad_drop}/snap=0003")
    again = RF.refresh_once(spark, "ledger", bad_drop, table)
    assert _rows(again) == _rows(full)


def test_refresh_records_errors_and_keeps_running(spark):
    table = scratch_path(spark, "t-err-table")
    writer = RF.snapshot_writer(spark, "ledger", table, f"{table}/_q", f"{table}/_errors")
    drop = scratch_path(spark, "t-err-drop")
    batch = _drop(spark, drop, "0001", "A")
    gone = batch.select("value")
    parse, RF._parse = RF._parse, None  # any failure of the body
    try:
        writer(gone, 7)
    finally:
        RF._parse = parse
    errs = spark.read.parquet(f"{table}/_errors").collect()
    assert len(errs) == 1 and errs[0].epoch == 7 and errs[0].snap == "0001"
    assert RF.read_current(spark, table) is None
    # the failed snapshot is tried again with the next batch, even one without valid rows
    writer(_drop(spark, drop, "0000", ""), 8)
    assert _names(spark, table) == ["A"]


def _drop(spark, drop, snap, *names):
    """A snapshot folder with one record per name, in a file of its own; its files as text."""
    for n in names:
        rec = f"<LEDGER><NAME>{n}</NAME></LEDGER>" if n else "<LEDGER><NAME>x & </LEDGER>"
        spark.createDataFrame([(rec,)], "value string").coalesce(1).write.mode("append").text(f"{drop}/snap={snap}")
    return spark.read.text(f"{drop}/snap={snap}")


def _names(spark, table):
    return sorted(r.ledger_name for r in RF.read_current(spark, table).collect())


def test_refresh_order_of_snapshots(spark):
    for first, then in (("0001", "0002"), ("0002", "0001")):
        table = scratch_path(spark, "t-order")
        for snap in (first, then):  # two drop folders, two checkpoints, one table
            drop = scratch_path(spark, "t-order-drop")
            _drop(spark, drop, snap, f"S{snap}")
            RF.refresh_once(spark, "ledger", drop, table)
        assert _names(spark, table) == ["S0002"]


def test_refresh_of_split_and_empty_snapshots(spark):
    table, drop = scratch_path(spark, "t-split"), scratch_path(spark, "t-split-drop")
    ckpt = scratch_path(spark, "t-split-ckpt")

    def trigger():
        RF.start_refresh(spark, "ledger", drop, table, ckpt, available_now=True).awaitTermination()

    _drop(spark, drop, "0001", "P1")
    trigger()
    _drop(spark, drop, "0001", "P2")  # the same snapshot's second file comes later
    trigger()
    assert _names(spark, table) == ["P1", "P2"]
    _drop(spark, drop, "0002", "Q")
    _drop(spark, drop, "0003", "")    # good and then empty in one batch
    trigger()
    assert _names(spark, table) == ["Q"]


def test_voucher_refresh_has_stored_schema(spark):
    drop = store.snapshot_drop_folder(spark, SMOKE, "voucher")
    got = RF.refresh_once(spark, "voucher", drop)
    assert [f.name for f in got.schema.fields] == ["date", "voucher_type", "voucher_no", "party_name",
                                                   "particulars", "debit_amount", "credit_amount", "entry_no"]
    want = X.scan_voucher_xml(spark, f"{drop}/snap=0002")
    assert got.count() == want.count()
    assert got.agg(F.sum("debit_amount")).first()[0] == want.agg(F.sum("debit_amount")).first()[0]


def test_report_sink_layouts_read_back_the_same_rows(spark):
    rows = spark.createDataFrame(
        [("A Co", "2023-2024", 0, 1.0), ("A Co", "2023-2024", 1, 2.0), ("B", "2023-2024", 0, 3.0)],
        "ledger_name string, financial_year string, seq int, balance double")
    got = {}
    for layout in ("sorted", "per_report"):
        path = scratch_path(spark, f"t-reports-{layout}")
        store.write_reports(rows, path, "Statement", layout=layout)
        got[layout] = sorted((r.file_key, r.seq, r.balance) for r in
                             spark.read.parquet(path).select("file_key", "seq", "balance").collect())
    assert got["sorted"] == got["per_report"] == [
        ("Statement_A_Co_2023-2024", 0, 1.0), ("Statement_A_Co_2023-2024", 1, 2.0),
        ("Statement_B_2023-2024", 0, 3.0)]


def test_versions_replace_refuse_and_vacuum(spark):
    from ledgerflow.sources import versions as V

    table = scratch_path(spark, "t-versions")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "a int")
    assert V.read_current(spark, table) is None and not V.drop(spark, table)
    assert V.publish(spark, rows(1), table, "0001") and V.publish(spark, rows(2, 3), table, "0002")
    assert not V.publish(spark, rows(), table, "0003")      # empty
    assert not V.publish(spark, rows(9), table, "0001")     # older than the published one
    assert V.publish(spark, rows(4), table, "0002")         # the same snapshot again
    rows(7).write.parquet(f"{table}/v=0009-000000")         # a crash before its pointer
    assert _rows(V.read_current(spark, table)) == [(4,)]
    assert V.vacuum(spark, table, keep=2) == ["v=0001-000000"]
    assert V.vacuum(spark, table, keep=1) == ["v=0002-000000"]
    assert _rows(V.read_current(spark, table)) == [(4,)]
    assert V.drop(spark, table) and V.read_current(spark, table) is None


def test_exports_are_compressed_slices_with_every_record(spark, tmp_path, monkeypatch):
    import os

    from ledgerflow.session import SHUFFLE_CLEANUP
    from ledgerflow.sources import fixtures as FX
    from ledgerflow.sources.bindings import Tables

    for f in os.listdir(SMOKE):
        os.symlink(f"{SMOKE}/{f}", tmp_path / f)
    monkeypatch.setattr(store, "RECORDS_A_FILE", 40)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    for kind, build, old in (("voucher", FX.voucher_xml_records, [("<VOUCHERNUMBER>", "<VOUCHERNUMBER>old-")]),
                             ("ledger", FX.ledger_xml_records, [("<PARENT>", "<PARENT>Old "), ('PARENT="', 'PARENT="Old ')])):
        drop = store.snapshot_drop_folder(spark, str(tmp_path), kind)
        want = [r["value"] for r in build(Tables(spark, SMOKE)).select("value").collect()]
        older = list(want)
        for a, b in old:
            older = [x.replace(a, b) for x in older]
        for snap, records in (("0002", want), ("0001", older)):
            folder = f"{drop}/snap={snap}".removeprefix("file:")
            names = [f for f in os.listdir(folder) if f.startswith("part-")]
            assert names and all(f.endswith(".gz") for f in names)
            lines = [r["value"] for r in spark.read.option("lineSep", "\n").text(folder).collect()]
            assert sorted(lines) == sorted(x for r in records for x in r.split("\n"))
            # each file is whole records, and a bounded number of them
            start = "<VOUCHER>" if kind == "voucher" else "<LEDGER"
            sizes = [r["value"].strip() for r in spark.read.text(folder, wholetext=True).select("value").collect()]
            assert [x[:60] for x in sizes if x and not x.startswith(start)] == []
            assert snap == "0001" or max(x.count(start) for x in sizes) <= 40 < len(records)
    assert spark.conf.get(SHUFFLE_CLEANUP) == before
    keys = spark.sql("select if(id % 5 = 0, null, id) as k, concat('<V>', id, '</V>') as value from range(100)")
    store.write_export(keys.repartition(3, "k"), "k", str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).select(F.countDistinct("value"), F.count("value")).first()[:] == (100, 100)


def test_published_versions_are_stored_with_zstd(spark):
    import os

    from ledgerflow.sources import versions as V

    table = scratch_path(spark, "versions")
    assert V.publish(spark, spark.range(10), table, "0001")
    names = [f for _, _, fs in os.walk(f"{table}/v=0001-000000".removeprefix("file:")) for f in fs if f.endswith(".parquet")]
    assert names and all(f.endswith(".zstd.parquet") for f in names)
    assert _rows(V.read_current(spark, table)) == [(i,) for i in range(10)]
