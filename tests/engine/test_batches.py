"""Batches of records: of many files, bounded, and with comments of any form."""

import pyarrow as pa

from siltstone.plans import parse


def test_records_of_many_files_are_one_batch():
    files = [(f"/{k}.php", f"<?php $a = $_GET['{k}']; system($a);" if k % 3 else "") for k in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array([p for p, _ in some]), pa.array([c for _, c in some])], ["path", "content"]) for some in (files[:100], files[100:])]
    out = list(parse.read_batches(iter(batches), "php"))
    assert len(out) == 1
    want = [(p, r["ord"], r["rec"], r["name"]) for p, c in files for r in parse.read_file(c, "php")]
    assert [(r["path"], r["ord"], r["rec"], r["name"]) for b in out for r in b.to_pylist()] == want


def test_batches_of_records_are_bounded(monkeypatch):
    monkeypatch.setattr(parse, "BATCH_ITEMS", 50)
    batch = pa.RecordBatch.from_arrays([pa.array([f"/{k}" for k in range(40)]), pa.array(["<?php $a = $b; f($a);"] * 40)], ["path", "content"])
    one = parse.read_file("<?php $a = $b; f($a);", "php")
    out = list(parse.read_batches(iter([batch]), "php"))
    assert len(out) > 1 and sum(b.num_rows for b in out) == 40 * len(one)
    assert max(b.num_rows for b in out) < 50 + len(one)


def test_long_comments_end_as_before():
    for text, count in (("/* a * b **/ x", 1), ("/*/ x */ y", 1), ("/* open *", 0), ("/**/z", 1), ("/* a\n*\n/ */ w", 1)):
        for language, before in (("php", "<?php "), ("javascript", "")):
            assert len(parse.tokens(before + text, language)) == count
