"""The K most similar pairs of token sets that are not candidates, for several configurations at once: exact, ties broken by keys.

Every configuration has its own sets of tokens, lengths and threshold; tokens have one order, the rarest
first, in all of them. A set that has its first token of that order in common with another at place p (from 0) of its n cannot
be more similar to it than 1 - p / n. So places are events, taken in rounds of falling bound: a round joins the events that are
not below its bound and looks no further at pairs that older ones joined before. A pair is compared, unless lengths and places already show that it is less similar than
the K-th pair so far. A configuration ends when its K-th similarity has reached the bound: pairs not met are
less similar. Its next bound is the K-th similarity itself once that is cheap, else a step of GRID.

What a round joins is known before, by counts of events by token (and block). Where comparing would cost more
than counting what all pairs share, the full way does that instead: one join of all tokens.

Tokens that only one side has are counted, but take no part: they stand first in the order. Equal sets are one, and
pairs of sets become pairs of records only from the K-th similarity on, of the largest ids of either side. Candidates may be
pairs, or blocks: then records have a column `block`, and pairs of equal blocks (not null) are left out. Sets whose records are all of
one block leave the join with others of that block at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlens.model import CandidateSet
from pairlens.operators.simjoin import SLACK, document_frequency, jaccard, label_of, with_blocks, without
from pairlens.sources.shared import Written

Config = tuple[int, ...]
GRID = (1.0, 0.9, 0.8, 0.65, 0.5, 0.35, 0.2, 0.0)
CLOSE = 0.1  # a K-th similarity so little below a step is taken instead of it
FEW_ROWS = 3_000_000  # rows that a round may count, or compare at their price, whatever was joined before
SMALL = 10_000_000  # pairs of sets a configuration that are not worth a round
ROUND_ROWS = 1_000_000  # rows whose counting costs as much as a round by itself
GROWTH = 4  # times as many as all rounds before, otherwise
CELL = 700  # sets of either side that one task pairs for one token
TASK_ROWS = 1_000_000  # joined rows a task, where they are known
TOKENS_A_ROW = 50  # tokens of a set whose comparison costs as much as counting a joined row


def _ranks(frequency: DataFrame, written: Written) -> DataFrame:
    """t, rank: numbers that rise with the rarest-first order, of tokens that both sides have."""
    both = frequency.where("l_df > 0 AND r_df > 0").select("df", "t")
    # written, so that every reader sees the same numbers
    return written.table(both.repartitionByRange("df", "t").sortWithinPartitions("df", "t").select("t", F.monotonically_increasing_id().alias("rank")))


def coded_sets(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """config, id, n, tokens (ranks), block. docs: (id, tokens) and, if there are blocks, block."""
    block = F.col("block") if "block" in docs.columns else F.lit(None).cast("string").alias("block")
    rows = docs.select("id", F.size("tokens").alias("n"), block, F.explode("tokens").alias("t")).join(ranks, "t")
    coded = rows.groupBy("id", "n", "block").agg(F.sort_array(F.collect_list("rank")).alias("tokens"))
    return coded.select(F.lit("").alias("config"), "id", "n", "tokens", "block")


def coded_configs(tokens: DataFrame, ranks: DataFrame, blocks: DataFrame | None, configs: list[Config]) -> DataFrame:
    """The same for numbered tokens (id, f, t) in every configuration."""
    known = tokens.join(ranks, "t", "left")
    pair = F.when(F.col("rank").isNotNull(), F.struct("rank", "f"))
    fields = sorted({f for c in configs for f in c})
    coded = known.groupBy("id").agg(F.sort_array(F.collect_list(pair)).alias("all"), *[F.count_if(F.col("f") == f).alias(f"n{f}") for f in fields])
    coded = coded.join(blocks, "id", "left") if blocks is not None else coded.withColumn("block", F.lit(None).cast("string"))
    part = lambda c: F.transform(F.filter("all", lambda x: x["f"].isin(*c)), lambda x: x["rank"])
    rows = [F.struct(F.lit(label_of(c)).alias("config"), reduce(Column.__add__, [F.col(f"n{f}") for f in c]).cast("int").alias("n"), part(c).alias("tokens")) for c in configs]
    return coded.select("id", "block", F.inline(F.array(*rows))).where(F.size("tokens") > 0).select("config", "id", "n", "tokens", "block")


@dataclass
class Side:
    """Records of one side: sets (config, cls, n, tokens, rows, only), members (config, cls, id, block). only: the block of all rows of a set, where it is one."""

    sets: DataFrame
    members: DataFrame

    @staticmethod
    def of(coded: DataFrame, written: Written, members_at_once: bool) -> Side:
        """Tables are written: what reads them has short plans, and they survive lost executors."""
        coded = written.table(coded)
        sets = written.table(coded.groupBy("config", "n", "tokens").agg(F.min("id").alias("cls"), F.count("*").alias("rows"), _only().alias("only")))
        members = coded.join(sets.select("config", "n", "tokens", "cls"), ["config", "n", "tokens"]).select("config", "cls", "id", "block")
        return Side(sets, written.table(members) if members_at_once else members)


    @staticmethod
    def of_docs(coded: DataFrame, members: DataFrame, written: Written) -> Side:
        """The same where several records have one doc. coded: a row a doc; members: (doc, id) and, if there are blocks, block."""
        coded = written.table(coded.select("config", F.col("id").alias("doc"), "n", "tokens"))
        one = written.table(coded.groupBy("config", "n", "tokens").agg(F.min("doc").alias("cls")))
        block = F.col("block") if "block" in members.columns else F.lit(None).cast("string").alias("block")
        classes = coded.join(one, ["config", "n", "tokens"]).select("config", "doc", "cls")
        members = written.table(members.join(classes, "doc").select("config", "cls", "id", block))
        about = members.groupBy("config", "cls").agg(F.count("*").alias("rows"), _only().alias("only"))
        return Side(written.table(one.join(about, ["config", "cls"]).select("config", "n", "tokens", "cls", "rows", "only")), members)


def _only() -> Column:
    """The block of all rows of a group, where it is one."""
    return F.when((F.min("block") == F.max("block")) & (F.count("block") == F.count("*")), F.min("block"))


def _of_config(values: dict[str, float], other: float) -> Column:
    found = F.lit(other)
    for config, value in values.items():
        found = F.when(F.col("config") == config, F.lit(value)).otherwise(found)
    return found


def _reach(bound: Column) -> Column:
    """How many of a set's tokens stand at places whose bound is not below this one; tokens of one side stand first."""
    first = F.col("n") - F.size("tokens")
    return F.least(F.size("tokens"), F.greatest(F.lit(0), F.floor(F.col("n") * (1 - bound) + SLACK).cast("int") + 1 - first))


def _events(sets: DataFrame, name: str, old: Column, upto: Column) -> DataFrame:
    """A row for each event up to a reach; new: those behind an older reach."""
    first = (F.col("n") - F.size("tokens")).alias("first")
    rows = sets.select("config", "cls", "n", "rows", "only", first, old.alias("old"), F.posexplode(F.slice("tokens", F.lit(1), upto)).alias("p", "t"))
    columns = [F.col(c).alias(f"{name}{c}") for c in ("cls", "n", "rows", "only")]
    return rows.select("config", "t", *columns, (F.col("first") + F.col("p")).alias(f"{name}place"), (F.col("p") >= F.col("old")).alias(f"{name}new"))


def dealt(left: DataFrame, right: DataFrame, tasks: int) -> DataFrame:
    """Events joined by token. A token of more than CELL sets of a side is dealt to several cells: few and frequent tokens keep no task waiting."""
    many = lambda df, name: df.groupBy("config", "t").agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))
    hot = many(left, "lcells").join(many(right, "rcells"), ["config", "t"]).where("lcells > 1 OR rcells > 1")

    def cells(df: DataFrame, own: str, other: str) -> DataFrame:
        known = df.join(hot, ["config", "t"], "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("lcells", "rcells")})
        placed = known.withColumn(f"{own}cell", F.pmod(F.xxhash64(f"{own}cls"), F.col(f"{own}cells")).cast("int"))
        return placed.withColumn(f"{other}cell", F.explode(F.sequence(F.lit(0), F.col(f"{other}cells") - 1))).drop("lcells", "rcells")

    by = ["config", "t", "lcell", "rcell"]
    # a number of tasks: few bytes are much work here, so small partitions are not to be merged
    return cells(left, "l", "r").repartition(tasks, *by).join(cells(right, "r", "l").repartition(tasks, *by), by)


def _not_of_one_block(df: DataFrame) -> DataFrame:
    """Without pairs of sets of the same one block; mixed: whether some of their records may still be of one block."""
    apart = df.where(F.col("lonly").isNull() | F.col("ronly").isNull() | (F.col("lonly") != F.col("ronly")))
    return apart.withColumn("mixed", F.col("lonly").isNull() | F.col("ronly").isNull()).drop("lonly", "ronly")


PAIR = ["config", "lcls", "rcls"]
OF_BOTH = ["ln", "rn", "lrows", "rrows", "mixed"]  # of fixed width, so that they are added up without a sort


def _compared(joined: DataFrame, left: DataFrame, right: DataFrame, least: Column) -> DataFrame:
    """config, lc, rc, lrows, rrows, mixed, shared, sim of pairs that meet in this round first and may be as similar as least."""
    able = _not_of_one_block(joined).where(F.least("ln", "rn") >= F.greatest("ln", "rn") * least - SLACK)
    met = able.groupBy(*PAIR).agg(F.min("lplace").alias("lplace"), F.min("rplace").alias("rplace"), F.bool_and(F.col("lnew") | F.col("rnew")).alias("new"), *[F.first(c).alias(c) for c in OF_BOTH])
    rest = F.least(F.col("ln") - F.col("lplace"), F.col("rn") - F.col("rplace"))
    met = met.where(F.col("new") & (rest * (1 + least) >= least * (F.col("ln") + F.col("rn")) - SLACK)).select(*PAIR, *OF_BOTH)
    tokens = lambda sets, s: sets.select("config", F.col("cls").alias(f"{s}cls"), F.col("tokens").alias(f"{s}tokens"))
    both = met.join(tokens(left, "l"), ["config", "lcls"]).join(tokens(right, "r"), ["config", "rcls"])
    # exploded, so that it is made once for the rest of the row
    shared = both.select(*PAIR, *OF_BOTH, F.explode(F.array(F.size(F.array_intersect("ltokens", "rtokens")))).alias("shared"))
    return _with_sim(shared)


def _with_sim(pairs: DataFrame) -> DataFrame:
    sim = jaccard(F.col("shared"), F.col("ln"), F.col("rn")).alias("sim")
    return pairs.select("config", F.col("lcls").alias("lc"), F.col("rcls").alias("rc"), "lrows", "rrows", "mixed", F.col("shared").cast("long").alias("shared"), sim)


def _counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same of all pairs that share a token, by counting joined tokens."""
    side = lambda sets, s: sets.select("config", *[F.col(c).alias(f"{s}{c}") for c in ("cls", "n", "rows", "only")], F.explode("tokens").alias("t"))
    joined = _not_of_one_block(side(left, "l").join(side(right, "r"), ["config", "t"]))
    return _with_sim(joined.groupBy(*PAIR).agg(F.count("*").alias("shared"), *[F.first(c).alias(c) for c in OF_BOTH]))


@dataclass
class Search:
    """Both sides of a join and what its rounds have found. rounds: (config, round, bound, least) as taken."""

    left: Side
    right: Side
    candidates: DataFrame | None
    blocked: bool
    written: Written
    found: list[DataFrame] = field(default_factory=list)
    rounds: list[tuple[str, int, float, float | None]] = field(default_factory=list)
    _kept: DataFrame | None = None

    def kept(self) -> DataFrame | None:
        """config, lc, rc, kept: candidates by pairs of sets."""
        if self.candidates is not None and self._kept is None:
            side = lambda m, c, i: m.select("config", F.col("cls").alias(c), F.col("id").alias(i))
            named = self.candidates.select("lid", "rid").distinct().join(side(self.left.members, "lc", "lid"), "lid").join(side(self.right.members, "rc", "rid"), ["config", "rid"])
            self._kept = self.written.table(named.groupBy("config", "lc", "rc").agg(F.count("*").alias("kept")))
        return self._kept

    def freed(self, pairs: DataFrame) -> DataFrame:
        """config, lc, rc, shared, sim, free: pairs of records that are not candidates."""
        pairs = pairs.withColumn("free", F.col("lrows") * F.col("rrows"))
        if self.candidates is not None:
            pairs = pairs.join(self.kept(), ["config", "lc", "rc"], "left").withColumn("free", F.col("free") - F.coalesce("kept", F.lit(0)))
        elif self.blocked:
            # sets of one block each differ in it; others share some blocks, perhaps
            blocks = lambda m, c, n: m.where("block IS NOT NULL").groupBy("config", F.col("cls").alias(c), "block").agg(F.count("*").alias(n))
            mixed = pairs.where("mixed").select("config", "lc", "rc")
            same = mixed.join(blocks(self.left.members, "lc", "a"), ["config", "lc"]).join(blocks(self.right.members, "rc", "b"), ["config", "rc", "block"])
            same = same.groupBy("config", "lc", "rc").agg(F.sum(F.col("a") * F.col("b")).alias("kept"))
            pairs = pairs.join(same, ["config", "lc", "rc"], "left").withColumn("free", F.col("free") - F.coalesce("kept", F.lit(0)))
        return pairs.select("config", "lc", "rc", "shared", "sim", "free").where("free > 0")

    def least(self, k: int) -> dict[str, float]:
        """By configuration, the similarity of its k-th pair, where there are so many."""
        if not self.found:
            return {}
        order = Window.partitionBy("config").orderBy(F.desc("sim"))
        sums = reduce(DataFrame.unionAll, self.found).groupBy("config", "sim").agg(F.sum("free").alias("n"))
        rows = sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).orderBy("config", "place").collect()  # k rows a configuration
        held: dict[str, int] = {}
        out: dict[str, float] = {}
        for r in rows:
            held[r["config"]] = held.get(r["config"], 0) + r["n"]
            if held[r["config"]] >= k:
                out.setdefault(r["config"], r["sim"])
        return out

    def costs(self) -> dict[str, tuple[list[float], float]]:
        """By configuration: rows that a join of all events joins down to each bound of GRID, and the mean number of tokens of a set."""

        def side(sets: DataFrame, name: str) -> DataFrame:
            events = sets.select("config", "only", "n", F.size("tokens").alias("m"), F.posexplode("tokens").alias("p", "t"))
            bound = 1 - (F.col("n") - F.col("m") + F.col("p")) / F.col("n")
            step = reduce(Column.__add__, [(bound < g - SLACK).cast("int") for g in GRID])
            return events.select("config", "t", "only", "m", step.alias("step"), F.lit(name).alias("side"))

        both = side(self.left.sets, "l").unionAll(side(self.right.sets, "r"))
        upto = [F.count_if((F.col("side") == s) & (F.col("step") <= i)).alias(f"{s}{i}") for i in range(len(GRID)) for s in "lr"]
        by_block = both.groupBy("config", "t", "only").agg(*upto, F.sum("m").alias("m"))
        sums = [F.sum(f"{s}{i}").alias(f"{s}{i}") for i in range(len(GRID)) for s in "lr"]
        same = [F.coalesce(F.sum(F.when(F.col("only").isNotNull(), F.col(f"l{i}").cast("double") * F.col(f"r{i}"))), F.lit(0.0)).alias(f"s{i}") for i in range(len(GRID))]
        by_token = by_block.groupBy("config", "t").agg(*sums, *same, F.sum("m").alias("m"))
        last = len(GRID) - 1
        rows = [F.sum(F.col(f"l{i}").cast("double") * F.col(f"r{i}") - F.col(f"s{i}")).alias(f"j{i}") for i in range(len(GRID))]
        found = by_token.groupBy("config").agg(*rows, (F.sum("m") / F.sum(F.col(f"l{last}") + F.col(f"r{last}"))).alias("mean"))
        return {r["config"]: ([r[f"j{i}"] for i in range(len(GRID))], r["mean"]) for r in found.collect()}  # a row a configuration

    def meet(self, before: dict[str, float], now: dict[str, float], least: dict[str, float], rows: float = 0) -> DataFrame:
        """Pairs met between two bounds; a configuration without a bound before has had no round. rows: how many a join is expected to make."""
        tasks = max(int(self.left.sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(rows // TASK_ROWS))
        some = lambda sets: sets.where(F.col("config").isin(*now))
        nothing = F.lit(0)
        old = _reach(_of_config(before, 2.0)) if before else nothing  # no place has a bound of 2
        new = _reach(_of_config(now, 2.0))
        floor = _of_config(least, 0.0)
        l_sets, r_sets = some(self.left.sets), some(self.right.sets)
        return _compared(dealt(_events(l_sets, "l", old, new), _events(r_sets, "r", old, new), tasks), l_sets, r_sets, floor)

    def keep(self, pairs: DataFrame, least: dict[str, float]) -> None:
        """Holds on to pairs that can be among the best."""
        self.found.append(self.written.table(self.freed(pairs.where(F.col("sim") >= _of_config(least, 0.0)))))

    def run(self, configs: list[str], k: int, how: str = "auto") -> None:
        """Rounds until every configuration has its k best pairs. how: auto, full or prefix."""
        if how == "auto" and self.left.sets.count() * self.right.sets.count() <= SMALL * len(configs):
            how = "full"
        if how == "full":
            self.keep(_counted(self.left.sets, self.right.sets), {})
            return
        before: dict[str, float] = {}
        now = dict.fromkeys(configs, 1.0)
        least: dict[str, float] = {}
        costs = None
        number = 0
        while now:
            number += 1
            rows = sum(costs[c][0][_step(b)] for c, b in now.items() if c in costs) if costs else 0
            self.keep(self.meet({c: b for c, b in before.items() if c in now}, now, least, rows), least)
            least = self.least(k)
            self.rounds += [(c, number, now[c], least.get(c)) for c in sorted(now)]
            before = {**before, **now}
            open_ = [c for c in now if before[c] > 0 and not least.get(c, -1.0) >= before[c]]
            now = {}
            if open_:
                costs = costs or self.costs()
                full = []
                for c in open_:
                    bound = _next_bound(costs.get(c), before[c], least.get(c), how)
                    if bound is None:
                        full.append(c)
                    else:
                        now[c] = bound
                if full:
                    some = lambda sets: sets.where(F.col("config").isin(*full))  # noqa: B023, E731
                    self.found = [f.where(~F.col("config").isin(*full)) for f in self.found]
                    self.keep(_counted(some(self.left.sets), some(self.right.sets)), {c: s for c, s in least.items() if c in full})
                    self.rounds += [(c, number + 1, 0.0, None) for c in sorted(full)]

    def top(self, k: int) -> DataFrame:
        """config, lid, rid, shared, sim, rank of the k best pairs of each configuration."""
        least = self.least(k)
        floor = _of_config(least, -1.0)
        pairs = reduce(DataFrame.unionAll, self.found)
        above, ties = pairs.where(F.col("sim") > floor), pairs.where(F.col("sim") == floor)
        order = Window.partitionBy("config").orderBy(F.desc("sim"), F.desc("lid"), F.desc("rid"))
        ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        # ties go by the left key first, so the largest left keys that have one are enough, unless most of their partners are candidates
        first = self.written.table(ranked(self._records(above, k).unionAll(self._records(ties, k, 2 * k))))
        have = {r["config"]: r["n"] for r in first.groupBy("config").agg(F.count("*").alias("n")).collect()}  # a row a configuration
        short = [c for c in least if have.get(c, 0) < k]
        if not short:
            return first
        again = lambda df: df.where(F.col("config").isin(*short))
        return first.where(~F.col("config").isin(*short)).unionAll(ranked(self._records(again(above), k).unionAll(self._records(again(ties), k))))

    def _records(self, some: DataFrame, k: int, lefts: int = 0) -> DataFrame:
        """config, lid, rid, shared, sim: the record pairs of pairs of sets that can be among the k best of equal similarity; lefts: of that many left keys only, if not 0."""

        def largest(side: Side, c: str, i: str, b: str) -> DataFrame:
            """Members that can be in one of the k best pairs: with a partner's block left out, k larger ids are always among them."""
            order = lambda *by: F.row_number().over(Window.partitionBy("config", "cls", *by).orderBy(F.desc("id")))
            members = side.members.join(some.select("config", F.col(c).alias("cls")).distinct(), ["config", "cls"], "left_semi")
            if lefts and c == "lc":
                members = members.withColumn("place", F.row_number().over(Window.partitionBy("config").orderBy(F.desc("id")))).where(F.col("place") <= lefts)
            elif self.candidates is not None:
                kept = self.kept().groupBy("config", F.col(c).alias("cls")).agg(F.sum("kept").alias("kept"))
                members = members.join(kept, ["config", "cls"], "left").withColumn("place", order()).where(F.col("place") <= k + F.coalesce("kept", F.lit(0)))
            elif self.blocked:
                members = members.withColumn("place", order("block")).where(F.col("place") <= k)
                members = members.withColumn("place", order()).where(F.col("place") <= 2 * k)
            else:
                members = members.withColumn("place", order()).where(F.col("place") <= k)
            return members.select("config", F.col("cls").alias(c), F.col("id").alias(i), F.col("block").alias(b))

        rows = some.join(largest(self.left, "lc", "lid", "lblock"), ["config", "lc"]).join(largest(self.right, "rc", "rid", "rblock"), ["config", "rc"])
        rows = rows.where(F.col("lblock").isNull() | F.col("rblock").isNull() | (F.col("lblock") != F.col("rblock")))
        return without(rows.select("config", "lid", "rid", "shared", "sim"), self.candidates)

    def close(self) -> None:
        self.written.close()


def _step(bound: float) -> int:
    """The step of GRID whose events include those of a bound."""
    return next(i for i, g in enumerate(GRID) if g <= bound + SLACK)


def _rows_at(rows: list[float], bound: float) -> float:
    """Rows joined down to a bound, about, between those of the steps around it."""
    i = _step(bound)
    return rows[i] if i == 0 else rows[i - 1] + (rows[i] - rows[i - 1]) * (GRID[i - 1] - bound) / (GRID[i - 1] - GRID[i])


def _next_bound(cost: tuple[list[float], float] | None, bound: float, least: float | None, how: str) -> float | None:
    """The bound of a configuration's next round; none: its full join is cheaper."""
    rows, mean = cost if cost is not None else ([0.0] * len(GRID), 0.0)
    now, price = _step(bound), 0.5 + mean / TOKENS_A_ROW
    allowed = max(FEW_ROWS / price, GROWTH * rows[now])
    # as far as the rows allow, or to the next step with any new events; steps that add nothing cost nothing
    more = next((i for i in range(now + 1, len(GRID)) if rows[i] > rows[now]), len(GRID) - 1)
    far = max(more, *[i for i in range(now + 1, len(GRID)) if rows[i] <= max(allowed, rows[more])])
    target = GRID[far] if least is None else least if least >= GRID[far] - CLOSE else GRID[far]
    if how == "auto" and _rows_at(rows, target) * price + ROUND_ROWS > rows[-1]:
        return None
    return target


def _search(left: DataFrame, right: DataFrame, candidates: DataFrame | None, blocked: bool, written: Written) -> Search:
    at_once = blocked or candidates is not None
    return Search(Side.of(left, written, at_once), Side.of(right, written, at_once), candidates, blocked, written)


def search_sets(left: DataFrame, right: DataFrame, candidates: CandidateSet | None) -> Search:
    """left, right: (id, tokens), tokens distinct."""
    left, right, pairs = with_blocks(left.where(F.size("tokens") > 0), right.where(F.size("tokens") > 0), candidates)
    written = Written(left.sparkSession)
    left, right = written.table(left), written.table(right)  # read twice each
    ranks = _ranks(document_frequency(left, right), written)
    return _search(coded_sets(left, ranks), coded_sets(right, ranks), pairs, "block" in left.columns, written)


def search_texts(left: DataFrame, right: DataFrame, tokens_of: Callable[[Column], Column], candidates: CandidateSet | None) -> Search:
    """left, right: (id, text); tokens_of: the distinct tokens of a text. Equal texts are one before tokens are made, so records move without theirs."""
    written = Written(left.sparkSession)
    distinct = [written.table(x.groupBy("text").agg(F.min("id").alias("doc"))) for x in (left, right)]
    docs = [d.select(F.col("doc").alias("id"), tokens_of(F.col("text")).alias("tokens")).where(F.size("tokens") > 0) for d in distinct]
    l_members, r_members, pairs = with_blocks(*[x.join(d, "text").select("id", "doc") for x, d in zip((left, right), distinct, strict=True)], candidates)
    ranks = _ranks(document_frequency(*docs), written)
    sides = [Side.of_docs(coded_sets(d, ranks), m, written) for d, m in zip(docs, (l_members, r_members), strict=True)]
    return Search(*sides, pairs, "block" in l_members.columns, written)


def search_configs(left: DataFrame, right: DataFrame, candidates: CandidateSet | None, configs: list[Config]) -> Search:
    """left, right: numbered tokens (id, f, t)."""
    written = Written(left.sparkSession)
    left, right = written.table(left.select("id", "f", "t")), written.table(right.select("id", "f", "t"))  # read several times
    l_ids, r_ids, pairs = with_blocks(*[x.select("id").distinct() for x in (left, right)], candidates)
    blocks = (l_ids, r_ids) if "block" in l_ids.columns else (None, None)
    sides = left.select("t", F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select("t", F.lit(0), F.lit(1)))
    frequency = sides.groupBy("t").agg(F.sum("l").alias("l_df"), F.sum("r").alias("r_df")).withColumn("df", F.col("l_df") + F.col("r_df"))
    ranks = _ranks(frequency, written)
    return _search(*[coded_configs(x, ranks, b, configs) for x, b in zip((left, right), blocks, strict=True)], pairs, blocks[0] is not None, written)


def _held(df: DataFrame, order: list[Column]) -> DataFrame:
    """Few rows, kept on the driver so that what they were made of can be released."""
    rows = df.orderBy(*order).collect()  # k rows a configuration
    return df.sparkSession.createDataFrame(rows, df.schema)


def top_k(left: DataFrame, right: DataFrame, candidates: CandidateSet | None, k: int, how: str = "auto") -> DataFrame:
    """lid, rid, shared, sim of the k most similar pairs, in order. left, right: (id, tokens), tokens distinct; how: auto, full or prefix."""
    return _top_of(search_sets(left, right, candidates), k, how)


def top_k_texts(left: DataFrame, right: DataFrame, tokens_of: Callable[[Column], Column], candidates: CandidateSet | None, k: int, how: str = "auto") -> DataFrame:
    """The same for texts. left, right: (id, text); tokens_of: the distinct tokens of a text."""
    return _top_of(search_texts(left, right, tokens_of, candidates), k, how)


def _top_of(search: Search, k: int, how: str) -> DataFrame:
    search.run([""], k, how)
    top = _held(search.top(k).select("lid", "rid", "shared", "sim"), [F.desc("sim"), F.desc("lid"), F.desc("rid")])
    search.close()
    return top


def configured_top(left: DataFrame, right: DataFrame, candidates: CandidateSet | None, configs: list[Config], k: int, how: str = "auto") -> DataFrame:
    """config, lid, rid, shared, sim, rank of the k most similar pairs of each configuration."""
    search = search_configs(left, right, candidates, configs)
    search.run([label_of(c) for c in configs], k, how)
    top = _held(search.top(k).select("config", "lid", "rid", "shared", "sim", "rank"), [F.col("config"), F.col("rank")])
    search.close()
    return top


def considered(left: DataFrame, right: DataFrame, candidates: CandidateSet | None, configs: list[Config]) -> DataFrame:
    """config, n_pairs: pairs of records that share a token and are not candidates."""
    search = search_configs(left, right, candidates, configs)
    pairs = search.freed(_counted(search.left.sets, search.right.sets)).groupBy("config").agg(F.sum("free").alias("n_pairs"))
    out = _held(pairs, [F.col("config")])
    search.close()
    return out


def rounds(left: DataFrame, right: DataFrame, candidates: CandidateSet | None, k: int, schedule: tuple[float, ...] = GRID) -> DataFrame:
    """round, bound, n_compared, least: how many pairs of records each round of a fixed schedule compared, and the k-th similarity after it (null: fewer pairs)."""
    search = search_sets(left, right, candidates)
    rows, before, least = [], {}, {}
    for number, bound in enumerate(schedule, 1):
        met = search.written.table(search.freed(search.meet(before, {"": bound}, least)))
        n = met.agg(F.coalesce(F.sum("free"), F.lit(0))).first()[0]
        search.found.append(met)
        before, least = {"": bound}, search.least(k)
        rows.append((number, bound, n, least.get("")))
        if least.get("", -1.0) >= bound:
            break
    search.close()
    return left.sparkSession.createDataFrame(rows, "round int, bound double, n_compared long, least double")
