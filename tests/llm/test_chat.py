import itertools
import random
from collections import defaultdict

from marginalia.llm import chat, queries

NEXT = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}


def legal(roles):
    state = None
    for r in roles:
        if r not in NEXT[state]:
            return False
        state = r
    return state in (None, "assistant")


def least_cost(roles):
    """By trying everything: for each turn its role and whether it merges, then the shortest legal filling."""
    gaps = {}
    for a, b in itertools.product([None, "system", "user", "assistant"], ["system", "user", "assistant", "end"]):
        for n in range(4):
            for fill in itertools.product(["system", "user", "assistant"], repeat=n):
                path, ok = [a, *fill], True
                for x, y in itertools.pairwise(path):
                    ok &= y in NEXT[x]
                ok &= (path[-1] in (None, "assistant")) if b == "end" else b in NEXT[path[-1]]
                if ok:
                    gaps.setdefault((a, b), n)
    best = 1 << 30
    for new in itertools.product(["system", "user", "assistant"], repeat=len(roles)):
        for merged in itertools.product([False, True], repeat=len(roles)):
            cost, state, ok = 0, None, True
            for r, n, m in zip(roles, new, merged, strict=True):
                cost += 2 * (r != n)
                if m:
                    ok &= state == n
                    cost += 1
                elif (state, n) in gaps:
                    cost += 3 * gaps[state, n]
                else:
                    ok = False
                state = n
            if ok and (state, "end") in gaps:
                best = min(best, cost + 3 * gaps[state, "end"])
    return best if roles else 0


def test_least_cost_of_all_short_conversations():
    for n in range(5):
        for roles in itertools.product(["system", "user", "assistant", "tool"], repeat=n):
            assert chat.repair(list(roles))[0] == least_cost(roles), roles


def chats(spark, rows, parts=3):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost_note string").repartition(parts)


def rebuilt(rendered):
    """(role, text) of a rendered chat."""
    turns = [t for t in rendered.split("<|end|>\n") if t]
    return [tuple(t.removeprefix("<|").split("|>\n", 1)) for t in turns]


def test_long_conversations_across_partitions(spark):
    r = random.Random(4)
    rows = [(1, k, r.choice(["user", "assistant", "system", None, "tool"]), f"t{k}", None) for k in range(900)]
    rows += [(c, k, r.choice(["user", "assistant"]), r.choice(["x", None, ""]), None) for c in range(2, 30) for k in range(r.randint(1, 9))]
    rows += [(None, 1, "user", "no id", None), (None, None, None, None, None), (40, 1, "user", "twice", None), (40, 1, "user", "twice", None)]
    got = chat.format_chats(chats(spark, rows))
    assert got.count() == len(rows) and "cost_note" in got.columns
    groups, sources = defaultdict(list), defaultdict(list)
    none = lambda x: (x is not None, x)
    for x in got.collect():
        groups[x["conv_id"]].append(x)
    for x in rows:
        sources[x[0]].append(x)
    for conv, own in groups.items():
        own.sort(key=lambda x: (none(x["turn"]), none(x["role"]), none(x["text"])))
        source = sorted(sources[conv], key=lambda x: (none(x[1]), none(x[2]), none(x[3])))
        assert sorted(x["place"] for x in own) == list(range(1, len(own) + 1))
        own.sort(key=lambda x: x["place"])
        assert [(none(x["turn"]), none(x["role"]), none(x["text"])) for x in own] == [(none(x[1]), none(x[2]), none(x[3])) for x in source]
        assert sum(x["cost"] for x in own) == chat.repair([x[2] for x in source])[0]
        turns = rebuilt("".join(x["rendered"] for x in own))
        assert legal([role for role, _ in turns])
        said = "".join(t.replace("\n", "") for _, t in turns)
        assert said == "".join(x[3] or "" for x in source)
    assert chat.format_chats(chats(spark, rows).limit(0)).count() == 0
    clash = chat.format_chats(chats(spark, rows[-3:]).selectExpr("*", "'mine' AS Action", "7 AS ch_part"))
    assert "Action" not in clash.columns and {(x["action"], x["ch_part"]) for x in clash.collect()} <= {(a, 7) for a in ("keep", "merge", "insert", "relabel", "relabel+merge", "relabel+insert")}


def test_query(spark, sf_dir):
    got = queries.op4_chat_format(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
    groups, sources = defaultdict(list), defaultdict(list)
    for x in got.collect():
        groups[x["conv_id"]].append((x["place"], x["rendered"], x["cost"]))
    for x in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        sources[x["conv_id"]].append((x["turn"], x["role"]))
    assert all(legal([r for r, _ in rebuilt("".join(t for _, t, _ in sorted(own)))]) for own in groups.values())
    short = {c: [r for _, r in sorted(own)] for c, own in sources.items() if len(own) <= 4}
    assert short and all(sum(x for _, _, x in groups[c]) == least_cost(roles) for c, roles in short.items())  # by trying everything
