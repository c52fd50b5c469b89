import itertools
from collections import defaultdict

from grovetable.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def cheapest(roles):
    """The cost of the best repair, by trying every choice."""
    best = {0: 0}
    for role in roles:
        new = {}
        for p, c in best.items():
            for q in (1, 2, 3):
                relabel = 0 if chat.ROLES[q] == role else chat.RELABEL
                options = []
                if q in chat.FOLLOWS[p]:
                    options.append(0)
                if q == p:
                    options.append(chat.MERGE)
                if any(q in chat.FOLLOWS[m] for m in chat.FOLLOWS[p]):
                    options.append(chat.INSERT)
                for o in options:
                    new[q] = min(new.get(q, 1 << 30), c + relabel + o)
        best = new
    return min(c + {0: 0, 1: 2 * chat.INSERT, 2: chat.INSERT, 3: 0}[q] for q, c in best.items())


def legal(rendered):
    roles = [x.split("|>")[0] for x in rendered.split("<|") if x and not x.startswith("end")]
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return roles == ["user", "assistant"] * (len(roles) // 2) and len(roles) % 2 == 0


def test_every_short_conversation(spark):
    kinds = ["system", "user", "assistant", None, "tool"]
    convs = [c for n in (1, 2, 3, 4) for c in itertools.product(kinds, repeat=n)][:400]
    rows = [(i, t, r, f"t{t}") for i, c in enumerate(convs) for t, r in enumerate(c)]
    for block in (1024, 2):  # the second cuts conversations into many blocks
        pieces = chat.repair_conversations(spark.createDataFrame(rows, TURNS), block).collect()
        assert len(pieces) == len(rows)
        cost, text = defaultdict(int), defaultdict(str)
        for p in sorted(pieces, key=lambda p: p["pos"]):
            cost[p["conv_id"]] += p["cost"]
            text[p["conv_id"]] += p["rendered"]
        for i, c in enumerate(convs):
            assert cost[i] == cheapest([chat.known_role(r) for r in c]), c
            assert legal(text[i]), (c, text[i])


def test_awkward_rows(spark):
    rows = [(None, 0, "USER ", None), (1, None, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (2, 3, "assistant", "x" * 5000), (3, 0, "user", ""), (3, 1, "assistant", "ok")]
    table = spark.createDataFrame([(*r, "mine") for r in rows], TURNS + ", key string")
    pieces = chat.repair_conversations(table)
    got = {r["conv_id"]: r["rendered"] for r in chat.render_conversations(pieces).collect()}
    assert got[3] == "<|user|>\n<|end|>\n<|assistant|>\nok<|end|>\n"
    assert got[1] == "<|user|>\na\nb\nb<|end|>\n<|assistant|>\n<|end|>\n"
    assert got[None].startswith("<|user|>\n<|end|>") and all(legal(t) for t in got.values())
    assert chat.repair_conversations(table.limit(0)).count() == 0
