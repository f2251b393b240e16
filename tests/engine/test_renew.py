"""A renewed code database and its chains equal those made of all files."""

from pyspark.sql import functions as F

from siltstone.operators.joins import written_round
from siltstone.plans import codedb, renew
from siltstone.plans.parse import records

A = "<?php class A { public $b; function __destruct() { $this->b->act($this->c); } }"
B = "<?php class B { function act($p) { system($p); } }"


def trees(spark):
    old = {"/1/a.php": A, "/1/b.php": "<?php class B { function act($p) { } }", "/2/a.php": A, "/2/b.php": B, "/3/a.php": A, "/3/b.php": B, "/4/a.php": A + "\n" + B[5:], "/6/a.php": None}
    new = old | {"/1/b.php": B, "/5/a.php": A, "/5/b.php": B, "/6/a.php": ""}
    del new["/3/b.php"]
    make = lambda files: spark.createDataFrame(list(files.items()), "path string, content string")
    return make(old), make(new)


def found(df):
    return sorted(map(str, df.collect()))


def test_changes(spark):
    old, new = trees(spark)
    got = {tuple(r) for r in renew.changes(new, renew.sums(old)).collect()}
    assert got == {("/1/b.php", "changed"), ("/5/a.php", "added"), ("/5/b.php", "added"), ("/3/b.php", "removed")}
    assert renew.changes(new, renew.sums(new)).count() == 0
    assert {r.change for r in renew.changes(new.limit(0), renew.sums(old)).collect()} == {"removed"}


def test_renewed_equals_full(spark):
    old, new = trees(spark)
    before = written_round(records(old, "php"))
    changed = written_round(renew.changes(new, renew.sums(old)))
    rows = written_round(renew.renewed_records(before, new, changed))
    full = written_round(records(new, "php"))
    assert found(rows) == found(full)
    assert found(codedb.dataflow(rows)) == found(codedb.dataflow(full))
    chains = written_round(codedb.chains(before, projects="^/[^/]+/"))
    # chains of unchanged projects are handed on as they were, so a mark put on the old ones stays there and nowhere else
    got = renew.renewed_chains(chains.withColumn("sink", F.lit("kept")), rows, changed, "^/[^/]+/")
    expected = codedb.chains(full, projects="^/[^/]+/").withColumn("sink", F.when(F.col("project").isin("/2/", "/4/"), "kept").otherwise(F.col("sink")))
    assert found(got) == found(expected)
    assert {r.project for r in got.collect()} == {"/1/", "/2/", "/4/", "/5/"} and {r.project for r in chains.collect()} == {"/2/", "/3/", "/4/"}
