"""Group folds by sizes only, against the greedy pass over all groups."""

import random

from pyspark.sql import functions as F

from loomtab.operators import splits


def greedy(sizes, folds):
    load, out = [0] * folds, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = min(range(folds), key=lambda i: (load[i], i))
        load[f] += n
        out[g] = f
    return out


def test_deal_is_the_greedy_pass():
    r = random.Random(1)
    for _ in range(500):
        folds = r.randint(2, 7)
        load = [r.randint(0, 30) for _ in range(folds)]
        size, count, want = r.randint(1, 9), r.randint(1, 60), []
        mine, plain = load[:], load[:]
        for _ in range(count):
            f = min(range(folds), key=lambda i: (plain[i], i))
            plain[f] += size
            want.append(f)
        found = splits.deal(mine, size, count)
        ends = [a for a, _ in found[1:]] + [count]
        assert [t[(i - a) % len(t)] for (a, t), e in zip(found, ends, strict=True) for i in range(a, e)] == want
        assert mine == plain and len(found) <= folds


def test_groups_are_not_gathered(spark, monkeypatch):
    """6,000 groups, one of a third of all rows: as the greedy pass deals them, and few rows reach the driver."""
    r = random.Random(2)
    sizes = {f"g{i}": r.choice([1, 1, 1, 2, 3]) for i in range(6000)}
    sizes["hot"] = sum(sizes.values()) // 2
    groups = spark.createDataFrame(list(sizes.items()), "g string, n int")
    rows = groups.select("g", F.explode(F.sequence(F.lit(1), "n")).alias("i")).select(F.sha2(F.concat_ws(":", "g", "i"), 256).alias("row_id"), "g").cache()
    seen, collect = [], type(rows).collect

    def counted(self):
        out = collect(self)
        seen.append(len(out))
        return out

    monkeypatch.setattr(type(rows), "collect", counted)
    members = splits.group_kfold(rows, "g", 5)
    monkeypatch.undo()
    assert max(seen) <= 16 * splits.RANGES
    own = members.where("role = 'validation'").join(rows, "row_id").select("g", "fold").distinct()
    assert {x.g: x.fold for x in own.collect()} == greedy(sizes, 5)
