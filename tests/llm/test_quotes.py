import random
import re
from collections import defaultdict

from loomline.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, content int, row string"


def normal(t):
    return re.sub(r"\s+", " ", t.lower(), flags=re.ASCII).strip(" ")


def units(t):
    parts = [t, *re.split(r"\n[ \t\r]*\n", t), *t.split("\n")]
    return {p: len(p) for p in map(normal, parts) if p}


def brute(rows):
    parsed = []
    for conv, turn, role, text in rows:
        if text is None:
            parsed.append((conv, turn, role, None, 0, []))
            continue
        lines = text.split("\n")
        depth = [m.group().count(">") if (m := re.match(r"[ \t]*>(?:[ \t]*>)*", x)) else 0 for x in lines]
        own, passages = [], []
        for k, x in enumerate(lines):
            if depth[k]:
                body = re.sub(r"^[ \t]*>(?:[ \t]*>)*[ \t]?", "", x)
                if passages and passages[-1][2] == k - 1 and passages[-1][0] == depth[k]:
                    passages[-1][1] += "\n" + body
                    passages[-1][2] = k
                else:
                    passages.append([depth[k], body, k])
            elif not (k + 1 < len(lines) and depth[k + 1] and re.match(r"(?i)on .{1,300} wrote:[ \t\r]*$", x)):
                own.append(x)
        content = re.sub(r"\A(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+\Z", "", "\n".join(own)) if passages else text
        parsed.append((conv, turn, role, content, max(depth), [(d, t) for d, t, _ in passages]))
    first = {}
    for conv, turn, _, content, _, _ in parsed:
        if turn is not None:
            for u in units(content or ""):
                first[conv, u] = min(turn, first.get((conv, u), turn))
    replies = []
    for conv, turn, _, _, _, passages in parsed:
        t = 2**63 - 1 if turn is None else turn
        found = [(d, -size, k, first[conv, u]) for k, (d, said) in enumerate(passages) for u, size in units(said).items() if first.get((conv, u), t) < t]
        replies.append(min(found)[3] if found else None)
    up = {}
    for (conv, turn, *_), r in zip(parsed, replies):
        if r is not None and turn is not None:
            up[conv, turn] = min(r, up.get((conv, turn), r))

    def root(conv, t):
        while (conv, t) in up:
            t = up[conv, t]
        return t

    def way(conv, t):
        return [*way(conv, up[conv, t]), t] if (conv, t) in up else [t]

    out = [(c, t, role, content, d, len(p), r, root(c, t if r is None else r)) for (c, t, role, content, d, p), r in zip(parsed, replies)]
    walk = lambda x: ([] if x[6] is None else way(x[0], x[6])) + [2**63 - 1 if x[1] is None else x[1]]
    by_conv = defaultdict(list)
    for row in sorted(out, key=lambda x: (walk(x), x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")):
        by_conv[row[0]].append(row)
    return sorted(((*row, k) for rows in by_conv.values() for k, row in enumerate(rows)), key=str)


ROWS = [
    (1, 0, "user", "Hello there.\n\nHow do I bake   bread?\nThanks"),
    (1, 1, "assistant", "On Monday, someone wrote:\n> how do i bake bread?\n\nUse flour and water.\nThen wait."),
    (1, 2, "user", "> > How do I bake bread?\n> Use flour and water.\n> Then wait.\n\nHow long?"),
    (1, 3, "user", "A new subject"),
    (1, 4, "assistant", ">How long?\nAn hour.\n>> Use flour and water.\nIndeed.\n"),
    (1, 5, "user", "> never said by anyone\nstrange"),
    (1, 6, "user", "> A NEW\tsubject  \n\n\nyes\n\n"),
    (2, 0, "user", "> How do I bake bread?\nquoting another conversation"),
    (2, 1, "user", "a > b is not a quote\nOn this day he wrote:\nfine"),
    (3, 0, None, None), (3, 1, "user", ""), (3, None, "user", "> x\n> y"), (3, 2, "user", "x\ny"), (None, 1, "user", "> hi\nho"), (None, 0, "user", "hi"),
    (1, 2, "user", "> > How do I bake bread?\n> Use flour and water.\n> Then wait.\n\nHow long?"),
    (4, 0, "user", "long line"), (4, 1, "user", "> long line\n" * 20000 + "end"),
    (6, 0, "user", "first"), (6, 1, "user", "> first\nsecond"), (6, 2, "user", "> first\nthird"), (6, 3, "user", "> second\nfourth"), (6, 4, "user", "> fourth\nfifth"),
    (5, 3, "user", "self\n> self"), (5, 4, "user", "> later"), (5, 5, "user", "later"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)


def test_against_brute_force(spark):
    got = quotes.conversations(spark, frame(spark, ROWS))
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == brute(ROWS)
    by = {(r.conv_id, r.turn): r for r in got.collect()}
    assert [by[1, k].reply_to for k in range(7)] == [None, 0, 1, None, 2, None, 3]
    assert [by[1, k].thread for k in range(7)] == [0, 0, 0, 3, 0, 5, 3]
    assert by[1, 1].content == "Use flour and water.\nThen wait." and by[1, 2].quote_depth == 2
    assert [r.turn for r in quotes.in_reply_order(got.filter("conv_id = 1")).collect()] == [0, 1, 2, 2, 4, 3, 6, 5]
    assert [r.turn for r in quotes.in_reply_order(got.filter("conv_id = 6")).collect()] == [0, 1, 3, 4, 2]


def test_random_conversations(spark):
    rng = random.Random(6)
    said = defaultdict(list)
    rows = []
    for k in range(300):
        conv = rng.choice([1, 1, 1, 2, 3])
        turn = len(said[conv])
        text = "\n".join(rng.choice(["alpha beta", "gamma", "", "delta  Epsilon", f"only {k}"]) for _ in range(rng.randint(1, 4)))
        if said[conv] and rng.random() < 0.7:
            old = rng.choice(said[conv])
            text = "\n".join(f">{rng.choice(['', ' '])}{x}" for x in old.split("\n")) + "\n" + text
        said[conv].append(text)
        rows.append((conv, turn, "user", text))
    assert sorted(map(tuple, quotes.conversations(spark, frame(spark, rows)).collect()), key=str) == brute(rows)


def test_empty_and_plan(spark, sf_dir):
    from loomline.llm import catalog

    assert quotes.conversations(spark, frame(spark, ROWS).limit(0)).count() == 0
    got = catalog.QUERIES["op3_quotation_links"](spark, sf_dir)
    want = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert sorted((r.conv_id, r.turn, r.content) for r in got.collect()) == sorted((r.conv_id, r.turn, r.text) for r in want.collect())
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
