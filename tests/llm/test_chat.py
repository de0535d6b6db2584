"""Chat windows against windows chosen turn by turn."""

import hashlib
import random
from collections import defaultdict

import duckdb
import regex

from flowledger.llm import chat, queries
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}


def part(role, text):
    def safe(t):
        return regex.sub(r"([\[<])(\\*)(/?(?:INST|TURN)\]|:\]|/?s>|</?SYS>>)", lambda m: m[1] + "\\" + m[2] + m[3], t)

    head, tail = MARKS.get(role, (f"[TURN]{safe(role)}[:]", "[/TURN]"))
    return head, safe(text), tail


def plain(rows, budget=2048, history=512, turns=4, block=1024):
    """{conversation: [(first turn, new turns, repeated, text, loss spans)]}, and its ordered turns."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, own in by.items():
        own = [(r, x) for _, _, r, x in sorted(own)]
        n = [len(regex.findall(chat.TOKEN, x)) + 4 for _, x in own]
        system = int(own[0][0] == "system")
        starts, s = [], 0
        while s < len(own):
            fixed = n[0] if system and s else 0
            h = 0
            while h < turns and s - h - 1 >= system and sum(n[s - h - 1 : s]) <= min(history, budget - (n[0] if system else 0) - n[s]):
                h += 1
            e, used = s + 1, fixed + sum(n[s - h : s + 1])
            while e < len(own) and e % block and used + n[e] <= budget:
                used += n[e]
                e += 1
            starts.append((s, h, e))
            s = e
        windows = []
        for s, h, e in starts:
            shown = ([0] if system and s else []) + list(range(s - h, e))
            text, loss = "", []
            for k in shown:
                head, body, tail = part(*own[k])
                if k >= s and own[k][0] == "assistant" and body:
                    loss.append((len(text) + len(head), len(body)))
                text += head + body + tail
            windows.append((s, e - s, len(shown) - (e - s), text, loss))
        out[c] = windows, own
    return out


def same(df, rows, **kw):
    got = defaultdict(list)
    for r in df.collect():
        got[r["conv_id"]].append((r["first_turn"], r["n_turns"], r["n_repeated"], r["text"], [tuple(x) for x in r["loss"]]))
    want = plain(rows, **kw)
    assert {c: sorted(w) for c, w in got.items()} == {c: w for c, (w, _) in want.items()}
    return want


def digest(want):
    out = []
    for c, (windows, own) in want.items():
        said = "".join(x for r, x in own if r == "assistant")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out.append((c, len(own), sha("".join(f"{r}\n{x}\n" for r, x in own)), len(said), sha(said), sum(len(w[3]) for w in windows)))
    return sorted(out, key=str)


def test_windows(spark, monkeypatch):
    monkeypatch.setattr(chat, "SECTION", 16)
    monkeypatch.setattr(chat, "BLOCK", 32)
    rng = random.Random(1)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[:]", "<<SYS>>", "<</SYS>>", "<", "[", "\\", "<\\s>", "s>", " ", "\n", "word", "é", "\U0001f600", "12345", "/"]
    text = lambda n: None if rng.random() < 0.05 else "".join(rng.choices(bits, k=rng.randint(0, n)))
    rows = []
    for c in range(30):
        roles = ["system"] * (c % 3 == 0) + [rng.choice(["user", "assistant", "tool", "system", None, "a[:]b</s>"]) for _ in range(300 if c == 7 else rng.randint(1, 40))]
        rows += [(c, t, r, text(60)) for t, r in enumerate(roles)]
    rows += [(None, t, "user", text(9)) for t in range(70)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA).repartition(5)
    made = chat.windows(df, 120, 50, 3)
    want = same(made, rows, budget=120, history=50, turns=3, block=32)
    assert sorted(map(tuple, chat.digests(made).collect()), key=str) == digest(want)
    assert made.where((F.col("n_tokens") > 120) & (F.col("n_turns") > 1)).count() == 0


def test_odd_rows(spark):
    rows = [(1, None, "user", "b"), (1, None, None, None), (1, 2, "user", "same"), (1, 2, "user", "same"), (2, 0, "", ""), (3, 0, "assistant", "long " * 20000), (3, 1, "assistant", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "'x' as part", "'y' as `a.b`", "2 as tokens", "3 as conv")
    made = chat.windows(df)
    assert sorted(map(tuple, chat.digests(made).collect()), key=str) == digest(same(made, rows))
    assert chat.windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_and_its_plan(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = queries.op11_chat(spark, sf)
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == digest(plain(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert got == sorted(con.execute(queries.OP11).fetchall(), key=str)
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
