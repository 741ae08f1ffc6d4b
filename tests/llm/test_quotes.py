import random
from collections import Counter

from momentrank.llm import quotes


def test_parse():
    body, parts = quotes.parsed("Hello.\n> One  line.\n> Two\n>> deep\nBye\n > > also deep")
    assert body == "Hello.\nBye"
    assert [(p, v) for p, v, _ in parts] == [(0, 0), (1, 1), (1, 1), (2, 2), (3, 0), (4, 2)]
    assert parts[3][2] != parts[4][2] and quotes.pieces("ALSO\n deep") == [parts[5][2]]
    assert quotes.parsed(None) == ("", []) and quotes.parsed("") == ("", [])
    # wrapped anew, other case
    assert quotes.pieces("one two. three\nfour.") == quotes.pieces("One\ntwo.\nTHREE four.")


def brute(rows):
    said, out = {}, []
    got = [(c, t, r, *quotes.parsed(x)) for c, t, r, x in rows]
    for c, t, _, _, parts in got:
        if c is not None and t is not None:
            for _, level, h in parts:
                if not level:
                    said.setdefault((c, h), set()).add(t)
    up = {}
    for i, (c, t, _, _, parts) in enumerate(got):
        votes, level_of = {}, {}
        for p, level, h in parts:
            if level and c is not None and t is not None:
                level_of[p] = level
                origin = max((s for s in said.get((c, h), ()) if s < t), default=None)
                votes.setdefault(p, Counter())[origin] += 1
        best = {p: max(((n, o) for o, n in v.items() if o is not None), default=(0, None))[1] for p, v in votes.items()}
        replies = Counter()
        for p, o in best.items():
            if level_of[p] == 1 and o is not None:
                replies[o] += sum(votes[p].values())
        reply = max(((n, o) for o, n in replies.items()), default=(0, None))[1]
        if reply is not None:
            up[c, t] = max(up.get((c, t), reply), reply)
        out.append([len(votes), max(level_of.values(), default=0), sum(o is not None for o in best.values()), reply])
    order = {}
    for i, (c, t, r, body, _) in enumerate(got):
        top = t
        while (c, top) in up:
            top = up[c, top]
        out[i].append(top)
        if c is not None and t is not None:
            order.setdefault(c, []).append((top, t, r is not None, r or "", body, i))
    for own in order.values():
        for k, x in enumerate(sorted(own)):
            out[x[-1]].append(k)
    return [(g[0], g[1], g[2], g[3], *o, *([None] * (6 - len(o)) if len(o) < 6 else [])) for g, o in zip(got, out)]


def made():
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice(["ja", "no", "maybe", "so", "when"]) for _ in range(rng.randint(2, 6))) + rng.choice(".!?")
    rows = []
    for c in range(12):
        texts = []
        for t in range(rng.randint(1, 14)):
            lines = []
            for s in rng.sample(texts, min(len(texts), rng.randint(0, 2))):
                lines += ["> " + x for x in s.split("\n")] + ["my reply: " + sentence()]
            lines.append(sentence() + "\n" + sentence())
            texts.append("\n".join(lines))
            rows.append((c, t * (700 if c % 3 == 0 else 1), rng.choice(["user", "assistant", None]), texts[-1]))
    return rows + [(50, 0, "user", None), (50, 1, "user", "> never said.\nx"), (None, 1, "user", "> a"), (50, None, "user", "b"), (50, 1, "user", ""),
                   (51, 3, "user", "> later."), (51, 5, "user", "later."), (51, 9, "user", ">>> Later.\n> later.\nok" + "y " * 20000)]


def test_matches_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, thread int")
    got = sorted((tuple(r)[:10] for r in quotes.conversations(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert any(r[7] is not None for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.conversations(df).count() == 0


def test_line_ends_and_a_very_long_text():
    body, found = quotes.parsed("> He said so.\r\nYes.\r\n\r\nNo.\r\n")
    assert body == "Yes.\n\nNo."
    assert found == quotes.parsed("> He said so.\nYes.\n\nNo.")[1] and found[0][2] == quotes.pieces("he  said so.")[0]
    long = "> " + "word " * 200_000 + "\n" + "x. " * 200_000
    body, found = quotes.parsed(long)
    assert len(found) == 200_001 and body.count("x.") == 200_000
