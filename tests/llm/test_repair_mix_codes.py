"""Conversation repair, mixing and vector codes against brute force, and their odd rows."""

import heapq
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilsift.llm import op11_repair as rep
from veilsift.llm import op12_mixing as mixing
from veilsift.llm import op13_vector_codes as codes

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def many_parts(spark):
    """Ranges of few rows, so that conversations and sources spread over parts."""
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ------------------------------------------------------------------ repair (11)


def least_edits(rows):
    """(cost, audit) over all edit sequences, cheapest first, then ASCII: rows are (initial, fault)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        state = (i, roles[-1:] if roles else "", roles.startswith("s") and len(roles) == 1)
        if (state, audit) in seen or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add((state, audit))
        for c in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + c))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if fault != rep.LOST:
                extra = 3 if fault == rep.CUT else 0
                if initial < 3:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + "sua"[initial]))
                for c in "ua":
                    heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, roles + c))


def test_chart_gives_the_cheapest_and_least_audit():
    rng = random.Random(3)
    for _ in range(250):
        rows = [(rng.randrange(4), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 6))]
        cost, audit = rep.cheapest(rep.chart(bytes(3 * c + f for c, f in rows)))
        assert (cost, audit.replace("L", "K")) == least_edits(rows), rows


def test_any_split_gives_the_same_cell():
    rng = random.Random(4)
    for _ in range(100):
        row = bytes(rng.randrange(12) for _ in range(rng.randint(2, 90)))
        at = rng.randrange(1, len(row))
        assert rep.joined(rep.chart(row[:at]), rep.chart(row[at:])) == rep.chart(row)


def long_conversation(n, seed=5):
    rng = random.Random(seed)
    texts = ["Fine.", "No end", "", " ", "Why?", None] + [f"Text {i}." for i in range(n)]
    return [(7, i + rng.choice([0, 0, 3]), rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool", ""]), rng.choice(texts)) for i in range(n)]


def walked(rows):
    """Faults, cheapest audit and repaired lines of one conversation, from left to right."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for _, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", ())}
    step = {("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3, ("s", 0): 1}

    def offer(into, state, cost, audit, out):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = (cost, audit, out)

    def closed(states):
        for _ in range(3):
            for s, (cost, audit, out) in list(states.items()):
                for c, role in (("u", "user"), ("a", "assistant")):
                    if (c, s) in step:
                        offer(states, step[c, s], cost + 3, audit + "I", (out, f"{role}:"))
        return states

    best = closed(best)
    for (_, role, text), fault in zip(rows, faults):
        now = {}
        for s, (cost, audit, out) in best.items():
            offer(now, s, cost + 4, audit + "D", out)
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            if (role[:1], s) in step:
                offer(now, step[role[:1], s], cost + extra, audit + "K", (out, f"{role}:{text}"))
            for c, new in (("u", "user"), ("a", "assistant")):
                if (c, s) in step:
                    offer(now, step[c, s], cost + extra + 3, audit + "R", (out, f"{new}:{text}"))
        best = closed(now)
    cost, audit, out = min(best[s] for s in (0, 3) if s in best)
    lines = []
    while out:
        out, line = out
        lines.append(line)
    return cost, audit, lines[::-1], [faults.count(f) for f in ("blank", "duplicate", "truncated")]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_a_conversation_over_many_parts(spark, many_parts):
    rows = long_conversation(900)
    other = [(None, None, "user", "Hi."), (None, None, "user", "Hi."), (None, 1, "assistant", "Yes."), (8, 1, "system", "Be good.")]
    done = rep.repair(spark.createDataFrame(rows + other, SCHEMA).withColumn("part", F.lit("x")).withColumn("c", F.lit(1)))
    got = {r["conv_id"]: r for r in done.summary.collect()}
    lines = {}
    for r in sorted(done.turns.collect(), key=lambda r: r["at"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    parts = {r["part"] for r in done.turns.where("conv_id = 7").collect()}
    assert len(parts) > 5
    for conv, own in ((7, rows), (None, other[:3]), (8, other[3:])):
        cost, audit, told, faults = walked(own)
        r = got[conv]
        assert (r["cost"], r["audit"], lines.get(conv, [])) == (cost, audit, told)
        assert [r["blank"], r["duplicate"], r["truncated"]] == faults
    hashed = {r["conv_id"]: r["repaired_sha256"] for r in rep.digests(done.turns).collect()}
    import hashlib

    assert hashed[7] == hashlib.sha256("\n".join(lines[7]).encode()).hexdigest()
    assert got[None]["gaps"] == 0 and got[8]["audit"] == "D"
    turns = [t for _, t, _, _ in rows]
    assert got[7]["gaps"] == max(turns) - min(turns) + 1 - len(set(turns))


def test_repeated_rows_are_counted_and_no_rows_stay_none(spark):
    rows = [(1, 0, "user", "Hello."), *[(1, 1, "assistant", "Yes.")] * 5000, (1, 2, "user", "Bye."), (1, 3, "assistant", "Bye.")]
    r = rep.repair(spark.createDataFrame(rows, SCHEMA)).summary.first()
    assert (r["audit"], r["duplicate"], r["illegal"]) == ("KK" + "D" * 4999 + "KK", 4999, 4999)
    none = rep.repair(spark.createDataFrame([], SCHEMA))
    assert none.summary.count() == none.turns.count() == 0


def test_repair_of_a_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 200_000 + "end."), (1, 1, "assistant", " " * 300_000 + "cut" + " " * 300_000)]
    r = rep.repair(spark.createDataFrame(rows, SCHEMA)).summary.first()
    assert (r["audit"], r["cost"], r["truncated"]) == ("KK", 3, 1)


# ------------------------------------------------------------------ mixing (12)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_targets_fill_up_to_the_limit(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 3, "É": 700, "z": 0, None: 40}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, total = dict.fromkeys(sizes, 0.0), sum(sizes.values())
    free, left = set(sizes), float(total)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    assert got == pytest.approx(target)
    assert sum(got.values()) == pytest.approx(total)


def test_mix_is_near_its_targets_and_the_same_again(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), "w " * int(10 ** rng.uniform(0, 3.3))) for i in range(3000)]
    table = documents(spark, rows)
    out = [tuple(r) for r in mixing.mix(table).collect()]
    again = [tuple(r) for r in mixing.mix(table.repartition(3)).collect()]
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert len(out) == len(rows)
    for source in ("a", "b", "c", None):
        own = [r for r in out if r[1] == source]
        size, target = own[0][3], own[0][4]
        assert size == sum(r[2] for r in own)
        assert abs(sum(r[2] * r[5] for r in own) - target) <= 32
        rate = target / size
        assert {r[5] for r in own if r[2]} <= {int(rate), int(rate) + 1}


def test_every_document_keeps_its_mean(spark):
    """Over many sources alike each place is taken as often as the rate says, and no source is far off."""
    sizes = [1 + 37 * i % 90 for i in range(24)]
    rows = [(100 * s + i, f"s{s:03}", "w " * n) for s in range(600) for i, n in enumerate(sizes)]
    out = mixing.mix(documents(spark, rows), mixing.Mix(fan=8, tiers=(16,))).collect()
    for k in range(3):
        own = [r for r in out if r["doc_id"] // 100 % 3 == k]
        rate = own[0]["target"] / own[0]["source_size"]
        share = rate % 1
        error = (share * (1 - share) / 200) ** 0.5
        means = [sum(r["copies"] for r in own if r["doc_id"] % 100 == i) / 200 for i in range(len(sizes))]
        assert max(abs(m - rate) for m in means) <= 4 * error + 1e-9
        taken = {}
        for r in own:
            taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        # the few short documents cannot take all that the last long one leaves
        assert max(abs(t - own[0]["target"]) for t in taken.values()) <= max(sizes)


def test_odd_documents_of_a_mix(spark):
    rows = [(None, None, "a b"), (None, None, "a b"), (1, None, None), (2, "", ""), (3, "", " \n"), (4, "s", "x " * 200_000)]
    rows += [(9, "s", "one two three")] * 9000
    out = mixing.mix(documents(spark, rows).withColumn("copies", F.lit("x")).withColumn("size", F.lit("y"))).collect()
    assert len(out) == len(rows)
    assert all(r["copies"] == 0 for r in out if r["size"] == 0)
    assert max(r["copies"] for r in out) <= 3
    by = {s: (sum(r["size"] * r["copies"] for r in out if r["source"] == s), {r["target"] for r in out if r["source"] == s}) for s in ("", "s", None)}
    assert by[""] == (0, {0.0}) and by[None] == (12, {12.0})
    # the rest is a single unit of 9,000 documents and one document that is far longer than all of them
    assert len(by["s"][1]) == 1
    assert mixing.mix(documents(spark, rows).where("false")).count() == 0


# ------------------------------------------------------------- vector codes (13)


def test_equal_average_search_equals_a_full_search():
    rng = np.random.default_rng(2)
    for width, spread in ((1, 3), (4, 40), (4, 3), (16, 200)):
        entries = rng.integers(-spread, spread, (64, width))
        entries[rng.integers(0, 64, 10)] = entries[0]
        parts = rng.integers(-2 * spread, 2 * spread, (3000, width))
        found, best, compared = codes.nearest_entries(parts, codes.Book.of(entries))
        distance = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (found == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()
        assert compared < 3000 * 64


def test_search_skips_most_entries_of_the_given_vectors(spark):
    rows = codes.kept_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect()
    whole = np.floor(np.array([r["embedding"] for r in rows]) * 256).astype(np.int64)
    _, _, compared = codes.nearest_entries(whole[:, :4], codes.Book.of(whole[:64, :4]))
    assert compared < 0.7 * len(whole) * 64


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 16, 1), (1, [0.5] * 16, 1), (2, None, 1), (3, [None] * 16, 1), (4, [nan] * 16, 2), (5, [inf] * 16, 2)]
    rows += [(None, [0.25] * 16, None), (6, [], None), (7, [1e30, -1e30], 3), (8, [0.0] * 16, 3), (9, [-0.001] * 16, 4)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string")
    done = codes.compress(table)
    got = sorted(((r["vec_id"] or 0, r["codes"], r["error"]) for r in done.rows.collect()), key=str)
    assert [g[0] for g in got] == sorted([1, 1, 6, 7, 8, 9, 0], key=str)
    assert all(g[2] == 0 for g in got)  # as many entries as vectors
    assert done.books.shape == (16, 7, 1) and abs(done.books).max() == codes.most(16)
    empty = codes.compress(table.where("false"))
    assert empty.rows.count() == 0 and empty.books.size == 0
