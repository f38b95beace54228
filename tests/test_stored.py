"""The commit log, the append-only store and the stored feature index: races, updates, and results equal to those in memory."""

import random
import threading
from pathlib import Path

import pytest

from pyspark.sql import functions as F
from tessera.operators import artifacts, commits, feature_index, retrieval


def test_one_of_two_commits_wins(spark, tmp_path):
    path = str(tmp_path / "log")
    assert commits.committed(spark, path) == [] and commits.next_number([]) == 0
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(commits.commit(spark, path, 0, {"folder": f"f{i}"}))) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False, False, False, True] and len(commits.committed(spark, path)) == 1
    assert commits.commit(spark, path, 1, {"folder": "g"}) and not commits.commit(spark, path, 1, {"folder": "h"})
    assert [s["folder"] for s in commits.committed(spark, path)][1] == "g"


def artifact(spark, *rows):
    return spark.createDataFrame([(*r[:2], "Claim", None, r[2]) for r in rows], "object_id string, version string, object_type string, status string, payload string")


def outcomes(df):
    return sorted((r.object_id, r.version, r.outcome) for r in df.collect())


def test_artifacts_do_not_change(spark, tmp_path):
    path = str(tmp_path / "artifacts")
    assert outcomes(artifacts.save_artifacts(spark, path, artifact(spark, ("a", "1", "x"), ("b", "1", "y"), ("b", "1", "y")))) == [("a", "1", "INSERTED"), ("b", "1", "INSERTED")]
    assert outcomes(artifacts.save_artifacts(spark, path, artifact(spark, ("a", "1", "x"), ("b", "1", "z"), ("a", "2", "x")))) == [("a", "1", "UNCHANGED"), ("a", "2", "INSERTED"), ("b", "1", "CONFLICT")]
    assert outcomes(artifacts.save_artifacts(spark, path, artifact(spark, ("c", "1", "p"), ("c", "1", "q")))) == [("c", "1", "CONFLICT"), ("c", "1", "INSERTED")]
    assert artifacts.load(spark, path, artifacts.ARTIFACTS, object_id="b").first().payload == "y"
    assert commits.compact(spark, path) and artifacts.load(spark, path, artifacts.ARTIFACTS).count() == 4
    commits.vacuum(spark, path)
    assert artifacts.load(spark, path, artifacts.ARTIFACTS).count() == 4
    assert artifacts.load(spark, str(tmp_path / "none"), artifacts.ARTIFACTS).count() == 0


def test_a_lost_race_is_read_again(spark, tmp_path, monkeypatch):
    """Another writer commits between reading and committing: equal content is stored once, other content is a conflict."""
    path, real, other = str(tmp_path / "race"), commits.commit, []

    def late(spark, at, number, said):
        if not other:
            other.append(1)
            artifacts.save_artifacts(spark, path, artifact(spark, ("a", "1", "x"), ("b", "1", "theirs")))
        return real(spark, at, number, said)

    monkeypatch.setattr(commits, "commit", late)
    mine = artifacts.save_artifacts(spark, path, artifact(spark, ("a", "1", "x"), ("b", "1", "mine"), ("c", "1", "w")))
    assert outcomes(mine) == [("a", "1", "UNCHANGED"), ("b", "1", "CONFLICT"), ("c", "1", "INSERTED")]
    stored = artifacts.load(spark, path, artifacts.ARTIFACTS)
    assert sorted((r.object_id, r.payload) for r in stored.collect()) == [("a", "x"), ("b", "theirs"), ("c", "w")]


def test_concurrent_writers(spark, tmp_path):
    path, told = str(tmp_path / "both"), []
    write = lambda i: told.append(outcomes(artifacts.save_artifacts(spark, path, artifact(spark, ("same", "1", "x"), (f"own{i}", "1", "x")))))
    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = artifacts.load(spark, path, artifacts.ARTIFACTS).collect()
    assert sorted(r.object_id for r in rows) == ["own0", "own1", "own2", "same"]
    assert sorted(o for rows in told for _, _, o in rows) == ["INSERTED"] * 4 + ["UNCHANGED"] * 2


def test_lineage_and_reviews(spark, tmp_path):
    path = str(tmp_path / "lineage")
    links = lambda *rows: spark.createDataFrame([(p, c, "derived", e) for p, c, e in rows], artifacts.LINEAGE)
    artifacts.add_lineage(spark, path, links(("a", "b", ["e1"]), ("b", "c", [])))
    again = artifacts.add_lineage(spark, path, links(("a", "b", ["e2"]), ("c", "a", None)))
    assert sorted(r.outcome for r in again.collect()) == ["INSERTED", "UNCHANGED"]
    stored = artifacts.load(spark, path, artifacts.LINEAGE)
    assert stored.count() == 3 and stored.filter("parent_id = 'a'").first().evidence_ids == ["e1"]
    found = artifacts.ancestors(stored, spark.createDataFrame([("c",), ("z",)], "child_id string"))
    assert sorted((r.child_id, r.ancestor_id, r.steps) for r in found.collect()) == [("c", "a", 2), ("c", "b", 1)]
    reviews = str(tmp_path / "reviews")
    review = lambda p: spark.createDataFrame([("r1", "t", "OPEN", "1", p)], artifacts.REVIEWS)
    assert [artifacts.append_reviews(spark, reviews, review(p)).first().outcome for p in ("x", "x", "y")] == ["INSERTED", "UNCHANGED", "CONFLICT"]


def feature_rows(rng, entities, n):
    return sorted({(e, f"f{rng.randrange(n)}") for e in entities for _ in range(rng.randint(0, 8))})


def frame(spark, rows):
    return spark.createDataFrame([(e, f, "abc"[int(f[1:]) % 3]) for e, f in rows], "entity_id long, feature_id string, axis string")


def people(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "entity_id long")


def in_memory(features, entities, anchors, ceiling):
    index = retrieval.pruned(features, retrieval.document_frequency(features, entities), ceiling)
    found = retrieval.candidates(retrieval.axis_scores(index, anchors), 5)
    return sorted((r.l, r.r, r.axes, r.total, r["rank"]) for r in found.collect())


def test_index_is_what_memory_gives(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "index")
    rows = feature_rows(rng, range(60), 40)
    feature_index.build_index(spark, path, frame(spark, rows), people(spark, range(60)), buckets=8)
    with pytest.raises(ValueError):
        feature_index.build_index(spark, path, frame(spark, rows), people(spark, range(60)))
    asked = people(spark, [1, 7, 59, 1000])
    ask = lambda: sorted((r.l, r.r, r.axes, r.total, r["rank"]) for r in feature_index.neighbours(spark, path, asked, 5, ceiling=0.3).collect())
    assert ask() == in_memory(frame(spark, rows), people(spark, range(60)), asked, 0.3) and ask()
    # one more entity, and others in place of what they were
    more = feature_rows(rng, [7, 20, 60, 61], 40)
    touched = feature_index.update_index(spark, path, frame(spark, more), people(spark, [7, 20, 60, 61]))
    rows = [r for r in rows if r[0] not in (7, 20)] + more
    assert ask() == in_memory(frame(spark, rows), people(spark, range(62)), asked, 0.3)
    assert len(touched) < 8 or len(more) > 8
    assert feature_index.update_index(spark, path, frame(spark, more), people(spark, [7, 20, 60, 61])) == []
    assert ask() == in_memory(frame(spark, rows), people(spark, range(62)), asked, 0.3)


def test_an_added_entity_changes_its_buckets_only(spark, tmp_path):
    path = tmp_path / "index"
    feature_index.build_index(spark, str(path), frame(spark, [(i, f"f{i % 9}") for i in range(30)]), people(spark, range(30)), buckets=16)
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    touched = feature_index.update_index(spark, str(path), frame(spark, [(99, "f3"), (99, "f5")]), people(spark, [99]))
    after = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    assert all(after[p] == t for p, t in before.items()) and 1 <= len(touched) <= 2
    added = {str(p.parent.relative_to(path)).split("/", 1)[1] for p in after.keys() - before.keys()}
    assert added == {f"{t}/bucket={b}" for t in ("postings", "frequency") for b in touched} | {a for a in added if a.startswith(("entities", "members"))} and len(added) <= 6


@pytest.mark.parametrize(("rare", "limit"), [(2, 3), (5, 5), (12, 2), (1, 4), (1000, 5)])
def test_bounded_candidates_are_all_candidates(spark, rare, limit):
    rng = random.Random(rare)
    rows = [(e, f"f{int(rng.paretovariate(0.6)) % 50}") for e in range(80) for _ in range(6)]
    features, entities = frame(spark, sorted(set(rows))), people(spark, range(80))
    index = retrieval.pruned(features, retrieval.document_frequency(features, entities), ceiling=0.6).cache()
    for least in (1, 2):
        want = retrieval.candidates(retrieval.axis_scores(index), limit, least).select("l", "r", "axes", "total", "rank")
        got = retrieval.best_candidates(index, limit, least, rare).select("l", "r", "axes", "total", "rank")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count()
    assert retrieval.best_candidates(index.filter(F.lit(False)), limit).count() == 0


def test_ranked_is_all_pairs(spark):
    """Blocks of entities against all pairs: ties, several axes of a feature, repeated rows, entities that only they have, least axes."""
    rng = random.Random(11)
    rows = [(e * 7 - 300, f"f{int(rng.random() ** 2 * 60)}", rng.choice("abc")) for e in range(150) for _ in range(rng.randint(0, 12))]
    rows += rows[:20] + [(9999, "alone", "a"), (5000, "f1", None), (5001, "f1", None)]
    index = spark.createDataFrame(rows, "entity_id long, feature_id string, axis string")
    index = index.withColumns({"df": F.lit(5).cast("long"), "ic": F.round(1 + F.pmod(F.xxhash64("feature_id"), F.lit(4)) / 3, 3).cast(retrieval.IC)})
    scores = retrieval.axis_scores(index).cache()
    for limit, least in ((3, 1), (8, 2), (500, 1)):
        want = retrieval.candidates(scores, limit, least).cache()
        best = retrieval.ranked(index, limit, least, F.col("feature_id") < "f2", most_block=64).cache()
        plain = lambda df, *c: sorted(map(str, df.select(*c).collect()))
        columns = ["l", "r", "axes", "total", "rank"]
        assert plain(best, *columns) == plain(want, *columns) and best.count() > 100
        kept = scores.join(want, ["l", "r"], "left_semi")
        assert plain(retrieval.ranked_scores(best), "l", "r", "axis", "ic", "shared") == plain(kept, "l", "r", "axis", "ic", "shared")
        a, b = index.filter("feature_id < 'f2'").alias("a"), index.alias("b")
        met = a.join(b, F.expr("a.feature_id = b.feature_id")).select(F.col("a.entity_id").alias("l"), F.col("b.entity_id").alias("r")).distinct()
        assert plain(best.filter("marked"), "l", "r") == plain(want.join(met, ["l", "r"]), "l", "r")
    assert retrieval.ranked(index.limit(0)).count() == 0


def test_ranked_among_near_entities(spark, monkeypatch):
    """Groups with features of their own on one axis: blocks get near entities only, few entities are asked of all, results are those of all pairs."""
    rng = random.Random(4)
    rows = {(e, f"own{e // 40}-{rng.randrange(12)}", "a") for e in range(240) for _ in range(rng.randint(1, 5))}
    rows |= {(e, f"all{rng.randrange(30)}", "b") for e in range(240) for _ in range(3)} | {(e, "all0", "b") for e in range(240, 250)} | {(3, "own0-0", "b"), (300, None, "a")}
    index = spark.createDataFrame(sorted(rows, key=str) + [(5, "all1", "b")], "entity_id long, feature_id string, axis string")
    index = index.withColumns({"df": F.length("feature_id").cast("long"), "ic": F.round(1 + F.pmod(F.xxhash64("feature_id"), F.lit(4)) / 3, 3).cast(retrieval.IC)})
    scores, asked, whole = retrieval.axis_scores(index).cache(), [], retrieval._whole
    monkeypatch.setattr(retrieval, "_whole", lambda people, ids, opened, *rest: asked.append(opened.count()) or whole(people, ids, opened, *rest))
    for limit, least in ((3, 1), (6, 2), (30, 1)):
        want = retrieval.candidates(scores, limit, least).cache()
        best = retrieval.ranked(index, limit, least, F.col("feature_id") < "all2", near_block=8).cache()
        plain = lambda df, *c: sorted(map(str, df.select(*c).collect()))
        assert plain(best, "l", "r", "axes", "total", "rank") == plain(want, "l", "r", "axes", "total", "rank") and best.count() > 100
        assert plain(retrieval.ranked_scores(best), "l", "r", "axis", "ic", "shared") == plain(scores.join(want, ["l", "r"], "left_semi"), "l", "r", "axis", "ic", "shared")
    assert 0 < asked[0] < 60 and asked[-1] <= 251
    plainer = index.filter("axis = 'a' or feature_id like 'all%'").distinct()
    few = retrieval.candidates(retrieval.axis_scores(plainer), 4)
    columns = ["l", "r", "feature_id", "axis", "df", "ic"]
    assert plain(retrieval.ranked_features(plainer, 4, near_block=8), *columns) == plain(retrieval.shared_features(plainer, few, 1 << 30), *columns)


def test_a_bucket_has_the_files_that_its_rows_ask_for(spark, tmp_path, monkeypatch):
    """Else the tasks that write it, as many as buckets, hold more the more rows there are."""
    rows = [(i, f"f{i % 3}") for i in range(600)] + [(i, f"g{i // 2}") for i in range(600)]
    found = []
    for i, most in enumerate((1_000_000, 20)):
        monkeypatch.setattr(feature_index, "FILE_ROWS", most)
        path = str(tmp_path / f"index{i}")
        feature_index.build_index(spark, path, frame(spark, rows), people(spark, range(600)), buckets=2, unique=True)
        folder = feature_index.commits.committed(spark, path)[0]["folder"].removeprefix("file:")
        files = [len(list(Path(f"{folder}/{name}").glob("bucket=*/*.parquet"))) for name in ("postings", "entities")]
        found.append((files, sorted(map(tuple, feature_index.neighbours(spark, path, people(spark, [3, 8]), ceiling=0.6).collect()))))
    (few, plain), (many, same) = found
    assert plain == same and max(few) <= 2 * feature_index.SPREAD < min(many)
    monkeypatch.undo()
    path = str(tmp_path / "repeated")
    feature_index.build_index(spark, path, frame(spark, rows + rows), people(spark, range(600)), buckets=2)
    assert sorted(map(tuple, feature_index.neighbours(spark, path, people(spark, [3, 8]), ceiling=0.6).collect())) == plain
