"""Tables that only lead up to a result go with the step that wrote them; the result can be read all the same."""

from pathlib import Path

from strideframe.llm import jaccard, repeats
from strideframe.storage import passing_tables, scratch_path, shared_dir


def tables(spark):
    folder = Path(shared_dir(spark).removeprefix("file:")) / "strideframe"
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def names(found):
    return {n.rsplit("-", 1)[0] for n in found}


def documents(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, line), (2, line + " end"), (3, "other words that stand alone here"), (4, line), (4, line), (None, line), (5, None)]
    rows += [(10 + i, line + f" x{i} y{i}") for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_stages_leave_what_their_result_reads(spark):
    before = tables(spark)
    kept = jaccard.one_per_component(documents(spark))
    assert names(tables(spark) - before) <= {"classes", "ids"}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 5]

    before = tables(spark)
    out = repeats.without_repeats(documents(spark))
    assert names(tables(spark) - before) <= {"copies", "spans"}
    assert out.count() == 27 and {r.text for r in out.where("doc_id = 2").collect()} <= {"", " end", "d"}


def test_kept_tables_outlive_one_block(spark):
    with passing_tables(spark):
        with passing_tables(spark):
            gone, kept = scratch_path(spark, "gone"), scratch_path(spark, "kept", kept=True)
            for path in (gone, kept):
                spark.range(3).write.parquet(path)
        assert Path(kept.removeprefix("file:")).exists() and not Path(gone.removeprefix("file:")).exists()
        assert spark.read.parquet(kept).count() == 3
    assert not Path(kept.removeprefix("file:")).exists()
