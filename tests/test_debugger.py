"""The debugger against brute force, and its configurations, verdicts and files."""

import itertools
import random

import pytest

from pairlens.functions.numbering import numbered_rows
from pairlens.functions.text import numbered_tokens, token_sets
from pairlens.model import CandidateSet, KeyedTable
from pairlens.operators import bounded, simjoin
from pairlens.operators.blockers import block_equal
from pairlens.operators.rank_aggregation import aggregated
from pairlens.operators.suggestions import side_by_side
from pairlens.operators.verify import gold_similarity, label_counts, label_state, recall
from pairlens.plans.configs import leave_one_out, top_down
from pairlens.plans.engine import debug_blocker, debug_blocker_token_sets, debug_leave_one_out, debug_top_down, indexed_candidates, unknown_keys
from pairlens.plans.review import Review
from pairlens.sources import files, wrapped
from pairlens.streaming.labels import SCHEMA, read_labels, running_counts, running_state, verdict_changes

WORDS = "red green blue oak elm ash north south st. ave. 12 34".split()


def people(spark, n, seed):
    rng = random.Random(seed)
    pick = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, k)))
    rows = [(i, pick(3), pick(6) if rng.random() > 0.1 else None, rng.choice("abc"), rng.randint(1, 9)) for i in range(n)]
    return KeyedTable(spark.createDataFrame(rows, "id long, name string, address string, town string, age int").repartition(3), "id"), rows


@pytest.fixture(scope="module")
def data(spark):
    (left, lrows), (right, rrows) = people(spark, 40, 1), people(spark, 30, 2)
    return left, right, block_equal(left, right, "town", "town"), lrows, rrows


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def brute(lsets, rsets, excluded, k):
    out = [(jaccard(a, b), i, j) for i, a in lsets.items() for j, b in rsets.items() if (i, j) not in excluded and a & b]
    return sorted(out, reverse=True)[:k]


def grams(row):
    s = " ".join(x or "" for x in row[1:4]).lower()
    return {s[i : i + 3] for i in range(len(s) - 2)}


def excluded(lrows, rrows):
    return {(a[0], b[0]) for a, b in itertools.product(lrows, rrows) if a[3] == b[3]}


def numbered(row, fields):
    """Numbered over all fields, then only those kept."""
    out, seen = set(), {}
    for f in range(3):
        for w in (row[1 + f] or "").lower().split(" "):
            if w:
                n = seen.get(w, 0)
                seen[w] = n + 1
                if f in fields:
                    out.add((w, n))
    return out


@pytest.mark.parametrize("how", ["full", "prefix"])
@pytest.mark.parametrize("k", [5, 5000])
def test_kgrams_equal_brute_force(data, how, k):
    left, right, candidates, lrows, rrows = data
    got = debug_blocker(left, right, candidates, k, how=how)
    want = brute({r[0]: grams(r) for r in lrows}, {r[0]: grams(r) for r in rrows}, excluded(lrows, rrows), k)
    assert got.columns == ["similarity", "ltable.id", "rtable.id", "ltable.name", "rtable.name", "ltable.address", "rtable.address", "ltable.town", "rtable.town"]
    assert [tuple(r)[:3] for r in got.collect()] == want
    assert all(0 < s <= 1 for s, _, _ in want)


def test_token_sets_equal_brute_force(data):
    left, right, _, lrows, rrows = data
    sets = lambda rows: {r[0]: {w for x in r[1:4] if x is not None for w in x.lower().split(" ")} for r in rows}
    for how in ("full", "prefix"):
        got = [tuple(r)[:3] for r in debug_blocker_token_sets(left, right, None, 25, how=how).collect()]
        assert got == brute(sets(lrows), sets(rrows), set(), 25)


def test_equal_records_are_one_class(spark):
    rows = [(i, WORDS[i % 3] + " " + WORDS[i % 2], "abc"[i % 3]) for i in range(60)]
    table = KeyedTable(spark.createDataFrame(rows, "id long, name string, town string"), "id")
    kept = block_equal(table, table, "town", "town")
    sets = {i: set(name.split(" ")) | {town} for i, name, town in rows}
    banned = {(i, j) for i, _, a in rows for j, _, b in rows if a == b}
    for k in (7, 300, 10**5):
        got = [tuple(r)[:3] for r in debug_blocker_token_sets(table, table, kept, k, how="full").collect()]
        assert got == brute(sets, sets, banned, k)


def check_report(report, lrows, rrows, k):
    rows = report.top.orderBy("config", "rank").collect()
    for config in report.configs:
        got = [(r.sim, r.lid, r.rid) for r in rows if r.config == simjoin.label_of(config)]
        assert got == brute({r[0]: numbered(r, config) for r in lrows}, {r[0]: numbered(r, config) for r in rrows}, excluded(lrows, rrows), k)
    for s in report.statistics.collect():
        config = tuple(map(int, s.config.split("_")))
        assert s.mean_llen == pytest.approx(sum(len(numbered(r, config)) for r in lrows) / len(lrows))
        assert s.n_pairs == len(brute({r[0]: numbered(r, config) for r in lrows}, {r[0]: numbered(r, config) for r in rrows}, excluded(lrows, rrows), 10**6))


def test_leave_one_out(data):
    left, right, candidates, lrows, rrows = data
    report = debug_leave_one_out(left, right, candidates, 20)
    assert report.configs == [(0, 1, 2), (1, 2), (0, 2), (0, 1)]
    check_report(report, lrows, rrows, 20)
    shown = report.recommendations()
    first = report.top.where("config = '0_1_2' AND rank = 1").first()
    view = side_by_side(shown, "0_1_2", 1, report.correspondence).collect()
    assert [r.field for r in view] == ["id", "name", "address", "town"] and view[0].left == str(first.lid)


def test_top_down(data):
    left, right, candidates, lrows, rrows = data
    report = debug_top_down(left, right, candidates, 20)
    assert len(report.configs) == 4 and report.configs[0] == (0, 1, 2)
    check_report(report, lrows, rrows, 20)


def test_checks(spark, data):
    left, right, *_ = data
    twice = KeyedTable(left.df.unionAll(left.df), "id")
    with pytest.raises(ValueError, match="twice"):
        debug_leave_one_out(twice, right, None)
    unknown = CandidateSet(spark.createDataFrame([(999, 1)], "a long, b long"), "a", "b")
    with pytest.raises(ValueError, match="does not have"):
        debug_leave_one_out(left, right, unknown)


def test_configurations():
    assert leave_one_out(1) == [(0,)]
    assert top_down([], [], []) == [] and top_down([1.0], [5], [5]) == [(0,)]
    # two fields: the first of equal weights is safe, the other goes
    assert top_down([2.0, 2.0], [7, 7], [7, 7]) == [(0, 1), (0,)]
    # the length rule: without field 1 most tokens are kept on both sides
    assert top_down([3.0, 2.0, 1.0], [10, 1, 10], [10, 1, 10]) == [(0, 1, 2), (0, 2), (0, 1), (0,)]
    # no configuration keeps half: the least weight goes
    assert top_down([4.0, 3.0, 2.0, 1.0], [5, 5, 5, 5], [5, 5, 5, 5])[4:] == [(0, 2), (0, 1), (0,)]
    # no tokens at all: the rule fires at the first field, and later levels spare none
    assert top_down([1.0, 1.0, 1.0], [0, 0, 0], [0, 0, 0]) == [(0, 1, 2), (0, 2), (0, 1), (2,), (1,)]
    n = 6
    assert len(top_down([6.0, 5, 4, 3, 2, 1], [1] * n, [1] * n)) == 1 + n * (n - 1) // 2


def test_verdicts(spark):
    rows = [(1, 1, 2, True, 1), (2, 1, 2, False, 2), (1, 3, 4, True, 1), (1, 3, 4, None, 2), (2, 5, 6, True, 1)]
    state = label_state(spark.createDataFrame(rows, "iteration int, lkey long, rkey long, label boolean, at int"))
    assert sorted(map(tuple, state.collect())) == [(1, 2, 2, False), (5, 6, 2, True)]
    assert [tuple(r) for r in label_counts(state).collect()] == [(2, 1, 1)]


def test_gold(spark, data):
    left, right, _, lrows, rrows = data
    gold = spark.createDataFrame([(1, 1), (2, 3), (999, 1)], "lkey long, rkey long")
    a, b = (numbered_tokens(t.df, "id", ["name", "address", "town"]) for t in (left, right))
    got = {(r.lkey, r.rkey): r.sim for r in gold_similarity(gold, a, b).collect()}
    side = lambda rows, i: next((numbered(r, (0, 1, 2)) for r in rows if r[0] == i), set())
    assert got == {(i, j): pytest.approx(jaccard(side(lrows, i), side(rrows, j))) for i, j in ((1, 1), (2, 3), (999, 1))}
    top = spark.createDataFrame([("c", 1, 1), ("c", 5, 5)], "config string, lid long, rid long")
    assert [tuple(r) for r in recall(top, gold).collect()] == [("c", 1, 3, pytest.approx(1 / 3))]


def test_files(spark, data, tmp_path):
    left, right, candidates, *_ = data
    report = debug_leave_one_out(left, right, candidates, 5)
    shown = report.recommendations()
    files.write_lists(shown, f"{tmp_path}/lists")
    assert spark.read.parquet(f"{tmp_path}/lists").count() == shown.count()
    files.write_text_lists(shown, f"{tmp_path}/text")
    assert spark.read.text(f"{tmp_path}/text/config=0_1").first()[0] == "======Tuple 1======"
    files.write_statistics(report.statistics, f"{tmp_path}/stats")
    assert spark.read.csv(f"{tmp_path}/stats", header=True).count() == 4
    names = [a for a, _ in report.correspondence]
    wrapped.write_wrapped(shown, names, f"{tmp_path}/wrapped")
    again = {(r.config, r["rank"], r.lkey, r.rkey, tuple(r.lvalues), tuple(r.rvalues)) for r in wrapped.read_wrapped(spark, f"{tmp_path}/wrapped", 5).collect()}
    assert again == {(r.config, r["rank"], str(r.lkey), str(r.rkey), tuple(r.lvalues), tuple(r.rvalues)) for r in shown.collect()}
    assert [r.config for r in wrapped.read_wrapped(spark, f"{tmp_path}/wrapped").where("config = '0_1' AND rank = 1").collect()] == ["0_1"]
    with pytest.raises(Exception, match="has not 6 pairs|fewer than 6 pairs"):
        wrapped.read_wrapped(spark, f"{tmp_path}/wrapped", 6).collect()
    wrapped.write_wrapped(shown.where("config = '0_1'"), names, f"{tmp_path}/wrapped")  # overwrites all
    assert wrapped.read_wrapped(spark, f"{tmp_path}/wrapped").select("config").distinct().count() == 1
    with pytest.raises(ValueError, match="inside a pair"):
        wrapped.parse_wrapped(["a", "1", "2", "x"])
    with pytest.raises(Exception, match="line break"):
        wrapped.write_wrapped(spark.createDataFrame([("c", 1, 1, 2, ["a\nb"], ["c"])], "config string, rank int, lkey long, rkey long, lvalues array<string>, rvalues array<string>"), ["x"], f"{tmp_path}/broken")
    one = tmp_path / "lists.txt"  # two lists of two pairs in one file, as the reviewers' tool has them
    one.write_text("x@_@_@_@y\n" + "".join(f"l{i}\nr{i}\na{i}\nb{i}\nc{i}\nd{i}\n" for i in range(4)))
    got = sorted(tuple(map(str, r)) for r in wrapped.read_wrapped(spark, str(one), 2).collect())
    assert got[3] == ("1", "2", "l3", "r3", "['a3', 'b3']", "['c3', 'd3']") and got[0][:3] == ("0", "1", "l0")
    order = [simjoin.label_of(c) for c in report.configs]
    files.write_transposed(report.statistics, ["name", "address", "town"], order, f"{tmp_path}/transposed")
    fields, rows = files.read_transposed(spark, f"{tmp_path}/transposed")
    stats = {r.config: r for r in report.statistics.collect()}
    assert fields == ["name", "address", "town"] and rows["n_pairs"] == [stats[c].n_pairs for c in order] and rows["mean_llen"] == pytest.approx([stats[c].mean_llen for c in order])
    (tmp_path / "t.csv").write_text('ID,name\nk1,"a, b"\nk2,"say ""x"""\n')
    table = files.read_table(spark, f"{tmp_path}/t.csv", "ID")
    assert sorted(map(tuple, table.df.collect())) == [("k1", "a, b"), ("k2", 'say "x"')]
    with pytest.raises(ValueError, match="no column"):
        files.read_table(spark, f"{tmp_path}/t.csv", "key")
    (tmp_path / "gold.csv").write_text("id1,id2\r\n2,1\r\n")
    keys = files.gold_keys(files.read_gold(spark, f"{tmp_path}/gold.csv"), table, table, "ID", "ID")
    assert [tuple(r) for r in keys.collect()] == [("k2", "k1")]
    assert [tuple(r) for r in files.lower_and_limit(spark.createDataFrame([(2, "B"), (1, "A")], "i int, s string"), "i", 1).collect()] == [(1, "a")]
    assert files.read_candidates(spark, f"{tmp_path}/gold.csv", "id1", "id2").pairs().count() == 1


def test_label_stream(spark, tmp_path):
    rows = [(1, 1, 2, True, "2020-01-01 00:00:00"), (1, 1, 2, False, "2020-01-01 00:05:00"), (1, 3, 4, True, "2020-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "iteration int, lkey long, rkey long, label boolean, at string")
    df.write.json(f"{tmp_path}/in")
    assert "label boolean" in SCHEMA
    for name, stream in (("state", running_state), ("counts", running_counts)):
        query = stream(read_labels(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.processAllAvailable()
        query.stop()
    assert sorted(tuple(r) for r in spark.table("state").select("lkey", "label").collect()) == [(1, False), (3, True)]
    assert sorted(tuple(r)[1:] for r in spark.table("counts").collect()) == [(1, 0), (1, 1)]


def test_verdict_changes(spark, tmp_path):
    """Toggled verdicts replayed file by file end in the batch state; verdicts too late count for nothing, old ones are let go."""
    steps = [
        [(1, 1, 2, True, "2020-01-01 00:00:00"), (1, 1, 2, False, "2020-01-01 00:05:00"), (1, 3, 4, True, "2020-01-01 00:20:00")],
        [(2, 1, 2, True, "2020-01-01 00:30:00"), (1, 3, 4, None, "2020-01-01 00:31:00"), (2, 5, 6, False, "2020-01-01 00:32:00"), (2, 5, 6, True, "2020-01-01 00:10:00")],
        [(3, 7, 8, True, "2020-01-01 05:00:00")],
        [(3, 5, 6, True, "2020-01-01 00:40:00"), (3, 7, 8, False, "2020-01-01 05:01:00")],  # the first is hours late
        [(4, 9, 9, True, "2020-01-03 05:00:00")],
        [(4, 9, 9, False, "2020-01-03 05:01:00")],
    ]
    kind = "iteration int, lkey long, rkey long, label boolean, at string"
    (tmp_path / "in").mkdir()
    changes = verdict_changes(read_labels(spark, f"{tmp_path}/in"), "1 hour", 24 * 3600 * 1000)
    out = []
    query = None
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, kind).coalesce(1).write.json(f"{tmp_path}/step{i}")
        next((tmp_path / f"step{i}").glob("part*.json")).rename(tmp_path / "in" / f"{i}.json")
        if query is None:
            query = changes.writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/check").start()
        query.processAllAvailable()
    query.stop()
    last = {}
    for r in out:
        last[r.lkey, r.rkey] = (r.iteration, r.label, r.expired)
    in_time = [r for rows in steps for r in rows if r != steps[3][0]]
    state = {(r.lkey, r.rkey): (r.iteration, r.label) for r in label_state(spark.createDataFrame(in_time, kind)).collect()}
    assert {k: v[:2] for k, v in last.items() if v[1] is not None} == state
    assert last[1, 2] == (2, True, True) and last[3, 4][1:] == (None, True) and last[9, 9] == (4, False, False)


def test_review_equals_fresh_search(data):
    left, right, candidates, _, _ = data
    names = ["name", "address", "town"]
    review = Review(left, right, (names, names), candidates, [(0, 1, 2), (0,)], 8)
    first = review.next().collect()
    judged = left.df.sparkSession.createDataFrame([(r.lid, r.rid) for r in first if r["rank"] % 3], "lid long, rid long")
    key = lambda r: (r.config, r.lid, r.rid, r.sim, r["rank"])
    more = CandidateSet(candidates.pairs().unionAll(judged), "lid", "rid")
    want = Review(left, right, (names, names), more, [(0, 1, 2), (0,)], 8).next()
    assert sorted(map(key, review.next(judged).collect())) == sorted(map(key, want.collect())) and review.searches == 1
    many = bounded.configured_top(*(numbered_tokens(t.df, "id", names) for t in (left, right)), candidates, [(0, 1, 2)], 100)
    again = review.next(many).where("config = '0_1_2'").collect()
    assert len(again) == 8 and review.searches == 2 and again[0].sim <= many.agg({"sim": "min"}).first()[0]


def test_rank_aggregation(spark):
    top = spark.createDataFrame([("a", 1, 1, 1), ("a", 2, 2, 2), ("b", 2, 2, 1), ("b", 3, 3, 2), ("c", 3, 3, 1), ("c", 2, 2, 3)], "config string, lid long, rid long, rank int")
    assert [tuple(r) for r in aggregated(top, 3).orderBy("place").collect()] == [(1, 2, 2, 3, 6, 2.0), (2, 3, 3, 2, 5, 2.0), (3, 1, 1, 1, 3, 4.0)]
    assert [r.lid for r in aggregated(top, 3, "median").orderBy("place").collect()] == [2, 3, 1]
    with pytest.raises(ValueError, match="no such"):
        aggregated(top, 3, "mean")
    assert aggregated(top.limit(0), 3).collect() == []


def test_rounds_with_candidate_pairs_and_ties(spark, monkeypatch):
    """Candidates as pairs, many equal records, and blocks some of which are null, by every way."""
    monkeypatch.setattr(bounded, "CELL", 2)
    monkeypatch.setattr(bounded, "FEW_ROWS", 10)
    monkeypatch.setattr(bounded, "SMALL", 0)
    rng = random.Random(9)
    rows = [(i, rng.choice(["red oak", "red elm", "blue oak ash", "blue"]), rng.choice(["x", "y", None])) for i in range(50)]
    table = KeyedTable(spark.createDataFrame(rows, "id long, name string, town string"), "id")
    sets = {i: set(name.split(" ")) for i, name, _ in rows}
    docs = token_sets(table.df, "id", ["name"])
    same = {(a[0], b[0]) for a in rows for b in rows if a[2] == b[2] and a[2] is not None}
    some = {(a, b) for a, b in itertools.product(range(50), repeat=2) if (a * 7 + b) % 3 == 0 or a > 45}
    pairs = CandidateSet(spark.createDataFrame(sorted(some), "lid long, rid long"), "lid", "rid")
    for how, k in (("prefix", 3), ("auto", 60), ("full", 10**4)):
        for candidates, banned in ((block_equal(table, table, "town", "town"), same), (pairs, some)):
            got = [(r.sim, r.lid, r.rid) for r in bounded.top_k(docs, docs, candidates, k, how).collect()]
            assert got == brute(sets, sets, banned, k)
    empty = docs.limit(0)
    assert bounded.top_k(docs, empty, None, 5).collect() == [] and bounded.top_k(empty, empty, pairs, 5).collect() == []


def test_numbered_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), i, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "part int, id long, place string").repartition(7)
    got = {r.id: r.row for r in numbered_rows(df, ["part", "id"]).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {r[1]: i + 1 for i, r in enumerate(want)}
    assert numbered_rows(df.limit(0), ["id"]).collect() == []


def test_csv(spark, tmp_path):
    rows = [(1, "plain", None), (2, 'a "quoted", text', ""), (3, "two\nlines", "x"), (4, "\\N", "y")]
    files.write_csv(spark.createDataFrame(rows[:3], "id int, text string, more string"), f"{tmp_path}/a")
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/a").collect())) == rows[:3]
    (tmp_path / "b.csv").write_text('id,n\n1,2\nx,3\n4,5,6\n7,"8\n"\n9,10\n')
    good, bad = files.good_and_bad(files.read_csv(spark, f"{tmp_path}/b.csv", "id int, n int", bad=files.BAD))
    assert {r.id for r in good.collect()} >= {1, 9} and {r[files.BAD].strip() for r in bad.collect()} >= {"x,3", "4,5,6"}


def test_text_keys(spark):
    left = KeyedTable(spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"), "id")
    texts = CandidateSet(spark.createDataFrame([("1", "2"), ("2", "2")], "l string, r string"), "l", "r")
    got = indexed_candidates(texts, left, left).pairs()
    assert got.dtypes == [("lid", "bigint"), ("rid", "bigint")] and sorted(map(tuple, got.collect())) == [(1, 2), (2, 2)]
    bad = CandidateSet(spark.createDataFrame([("1", "7"), ("x", "2")], "l string, r string"), "l", "r")
    assert sorted(map(tuple, unknown_keys(bad, left, left).collect())) == [("left", "x"), ("right", "7")]


def test_text_keys_of_blocks(spark):
    """Blocks stay blocks, whose keys are looked up once a row and not once a pair."""
    rows = [(i, f"n{i % 4}") for i in range(30)]
    left = KeyedTable(spark.createDataFrame(rows, "id long, name string"), "id")
    texts = KeyedTable(left.df.selectExpr("CAST(id AS STRING) AS id", "name"), "id")
    got = indexed_candidates(block_equal(texts, texts, "name", "name"), left, left)
    assert [b.dtypes for b in got.blocks] == [[("id", "bigint"), ("block", "string")]] * 2
    want = sorted((i, j) for i, a in rows for j, b in rows if a == b)
    assert got.pairs().dtypes == [("lid", "bigint"), ("rid", "bigint")] and sorted(map(tuple, got.pairs().collect())) == want
    fractions = KeyedTable(left.df.selectExpr("CAST(id AS DOUBLE) / 4 AS id", "name"), "id")
    named = KeyedTable(fractions.df.selectExpr("CAST(id AS STRING) AS id", "name"), "id")
    halves = indexed_candidates(block_equal(named, texts, "name", "name"), fractions, left)
    assert sorted(map(tuple, halves.pairs().collect())) == [(i / 4, j) for i, j in want]
    with pytest.raises(ValueError, match="does not have"):
        indexed_candidates(block_equal(texts, texts, "name", "name"), left, KeyedTable(left.df.where("id > 0"), "id"))
    pairs = spark.createDataFrame([("1", "2"), ("2", "2")], "l string, r string")
    assert "Join" not in indexed_candidates(CandidateSet(pairs, "l", "r"), left, left).pairs()._jdf.queryExecution().optimizedPlan().toString()


def test_equal_texts_are_one_before_their_grams(spark, monkeypatch):
    """No table that is written holds the k-grams of each of many records of one text."""
    names = ["red oak", "red ash", "old elm st.", "no", None]
    rows = [(i, names[i % 5], "xyz"[i % 3] if i % 11 else None) for i in range(600)]
    table = KeyedTable(spark.createDataFrame(rows, "id long, name string, town string"), "id")
    held, write = [], bounded.Written.table

    def counted(self, df, *args, **more):
        out = write(self, df, *args, **more)
        held.extend(out.selectExpr("coalesce(sum(size(tokens)), 0)").first() if "tokens" in out.columns else [])
        return out

    monkeypatch.setattr(bounded.Written, "table", counted)
    banned = {(i, j) for i, _, a in rows for j, _, b in rows if a is not None and a == b}
    sets = {r[0]: {t[i : i + 3] for t in [f"{r[1] or ''} {r[2] or ''}"] for i in range(len(t) - 2)} for r in rows}
    for how in ("full", "prefix"):
        got = [tuple(r)[:3] for r in debug_blocker(table, table, block_equal(table, table, "town", "town"), 300, how=how).collect()]
        assert got == brute(sets, sets, banned, 300)
    assert held and max(held) < 300  # 20 texts
