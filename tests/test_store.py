"""One root over all tables: killed writers, two writers at once, readers that hold a root."""

import pytest

from loamline.engine import Engine
from loamline.sources.store import Root, Store


def pages(spark, word, n=3):
    return spark.createDataFrame([(i, f"https://h/{word}/{i}", f"{word} page {i} shared") for i in range(n)], "page_index long, url string, content string")


@pytest.fixture
def engine(spark, tmp_path):
    made = Engine(spark, str(tmp_path / "home"))
    made.add("https://h/one", label="one", pages=pages(spark, "one"))
    return made


def seen(engine):
    """The labels that a question finds, with what the statistics and the catalog say."""
    root = engine.store.root()
    chunks = root.chunks().count()
    assert root.statistics()[0] == chunks
    assert {r["resource_id"] for r in root.table("stats").collect()} == {r["id"] for r in root.table("resources").collect()} == {r["resource_id"] for r in root.table("snapshots").collect()}
    return {r["label"] for r in engine.query("shared", top_k=50).collect()}, chunks


@pytest.mark.parametrize("place", ["postings", "snapshots", "root"])
def test_a_killed_writer_leaves_nothing_to_see(engine, spark, monkeypatch, place):
    before, broken = seen(engine), RuntimeError("killed")
    write, put_new = Store._write, engine.store.files.put_new

    def failing(self, name, *rest):
        if name == place:
            raise broken
        return write(self, name, *rest)

    def table(self, name, kept=Root.table):
        if name == place and self.number:
            raise broken
        return kept(self, name)

    with monkeypatch.context() as m:
        m.setattr(Store, "_write", failing)
        m.setattr(engine.store.files, "put_new", put_new if place != "root" else lambda *_: (_ for _ in ()).throw(broken))
        if place == "snapshots":
            m.setattr(Root, "table", table)
        with pytest.raises(RuntimeError, match="killed"):
            engine.add("https://h/two", label="two", pages=pages(spark, "two", 5))
    assert seen(engine) == before == ({"one"}, 3)
    engine.add("https://h/two", label="two", pages=pages(spark, "two", 5))
    assert seen(engine) == ({"one", "two"}, 8)


def test_the_loser_of_two_writers_starts_again(engine, spark, monkeypatch):
    other, put_new, raced = Engine(spark, engine.store.home), engine.store.files.put_new, []

    def late(path, text):
        if not raced:  # another writer comes first, once
            raced.append(path)
            other.add("https://h/three", label="three", pages=pages(spark, "three", 2))
        return put_new(path, text)

    monkeypatch.setattr(engine.store.files, "put_new", late)
    engine.add("https://h/two", label="two", pages=pages(spark, "two", 4))
    assert raced and seen(engine) == ({"one", "two", "three"}, 9)
    assert not engine.store.files.put_new(raced[0], "{}")


def test_readers_hold_a_root_while_a_snapshot_is_indexed_anew(engine, spark):
    held, old = engine.store.root(), engine.store.root().table("stats").collect()
    engine.update("one", pages=pages(spark, "one", 6))
    assert held.chunks().count() == 3 and held.statistics()[0] == 3
    assert engine.store.root().statistics()[0] == 9  # both snapshots
    row = engine.show("one").first()
    indexed = engine.store.index(engine.store.snapshot_pages(row["id"], row["current"]))
    assert indexed.collect()[0]["n"] == 6 and engine.store.root().statistics()[0] == 9  # no root names that generation
    assert {r["generation"] for r in old} < {r["generation"] for r in engine.store.root().table("stats").collect()}
    engine.remove("one")
    assert engine.query("shared").count() == 0 and engine.store.root().statistics() == (0, 0)
