"""Quotation linking against a plain restatement: runs in order only, long messages, threads."""

import random
import re
import time

import duckdb
import pytest

from skillweave.llm import queries, quotations
from tests.llm.conftest import SMALL

MARKS = re.compile(r"([ \t]*>)*[ \t]*")


def plain(messages):
    """(n_passages, n_linked, reply_to, thread, depth) of each message (conv, turn, text), one message for a turn."""
    parsed, out = {}, {}
    for conv, turn, text in messages:
        lines = []
        for line in (text or "").split("\n"):
            marks = MARKS.match(line).group()
            lines.append((marks.count(">"), re.sub(r"\s+", " ", line[len(marks):]).strip(" ").lower()))
        parsed[conv, turn] = lines
    own = {k: [s for lv, s in v if lv == 0 and s] for k, v in parsed.items()}

    def says(words, run):
        return any(words[i:i + len(run)] == run for i in range(len(words) - len(run) + 1))
    for (conv, turn), lines in parsed.items():
        found, at = [], 0
        while at < len(lines):
            end = at
            while end < len(lines) and lines[end][0] == lines[at][0]:
                end += 1
            run = [s for _, s in lines[at:end] if s]
            if lines[at][0] and run:
                turns = [t for (c, t), words in own.items() if c == conv and t < turn and says(words, run)]
                found.append((lines[at][0], min(turns, default=None)))
            at = end
        out[conv, turn] = (len(found), sum(t is not None for _, t in found),
                           max((t for lv, t in found if lv == 1 and t is not None), default=None))
    full = {}
    for (conv, turn), x in out.items():
        at, depth = turn, 0
        while out[conv, at][2] is not None:
            at, depth = out[conv, at][2], depth + 1
        full[conv, turn] = (*x, at, depth)
    return full


def linked(spark, rows):
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    return {(r.conv_id, r.turn): (r.n_passages, r.n_linked, r.reply_to, r.thread, r.depth) for r in quotations.link(df).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rnd, rows = random.Random(seed), []
    word = lambda: rnd.choice(["a", "b", "B  b", "", "c"])
    for conv in range(12):
        texts = []
        for turn in range(rnd.randint(2, 14)):
            lines = [word() for _ in range(rnd.randint(1, 5))]
            for _ in range(rnd.randint(0, 2)):
                if texts:
                    source = rnd.choice(texts)
                    i = rnd.randrange(len(source))
                    lines[:0] = [">" + rnd.choice([" ", "", "> "]) + x for x in source[i:i + rnd.randint(1, 4)]]
            texts.append(lines)
            rows.append((conv, turn, "\n".join(lines)))
    assert linked(spark, rows) == plain(rows)


def test_another_order_is_another_text(spark):
    got = linked(spark, [(1, 0, "a a\nb b"), (1, 1, "> b b\n> a a\nno"), (1, 2, "> a a\n>\n> b b\nyes"), (1, 3, "> a a\n> a a")])
    assert got == {(1, 0): (0, 0, None, 0, 0), (1, 1): (1, 0, None, 1, 0), (1, 2): (1, 1, 0, 0, 1), (1, 3): (1, 0, None, 3, 0)}


def test_long_threads_and_depths(spark):
    rows = [(1, 0, "line 0")] + [(1, t, f"> line {t - 1}\nline {t}") for t in range(1, 40)]
    rows += [(2, t, f"> line {t - 1}\nline {t}") for t in range(7, 9)]
    got = linked(spark, rows)
    assert got[1, 39] == (1, 1, 38, 0, 39) and got[2, 8] == (1, 1, 7, 7, 1) and got == plain(rows)


def test_long_messages_take_time_by_their_length(spark):
    def run(n):
        said = "\n".join(f"line {i}" for i in range(2 * n))
        quoted = "\n".join(f"> line {i}" for i in range(n // 2, n // 2 + n))
        t = time.time()
        got = linked(spark, [(1, 0, said), (1, 1, quoted + "\nok"), (1, 2, "> x\n" * n + "x\n" * n), (1, 3, "> x\n" * (n - 1))])
        assert got[1, 1] == (1, 1, 0, 0, 1) and got[1, 2][:3] == (1, 0, None) and got[1, 3] == (1, 1, 2, 2, 1)
        return time.time() - t
    run(10)
    short, long = run(500), run(20_000)
    assert long < 10 + short


def test_the_query_quotes_whole_turns_and_their_turn_is_found(spark):
    got = {(r.conv_id, r.turn): r for r in queries.op3_quotation_linking(spark, SMALL).collect()}
    turns = dict(((c, t), x) for c, t, x in duckdb.sql(
        f"SELECT conv_id, turn, min(text) FROM '{SMALL}/conversations.parquet' GROUP BY 1, 2").fetchall())
    replies = [(c, t) for c, t in turns if (c, t - 1) in turns and turns[c, t - 1].strip()]
    assert replies and sum("\n" in turns[c, t - 1] for c, t in replies) > 10
    first = {}
    for (c, t), x in sorted(turns.items()):
        first.setdefault((c, x), t)
    assert all(got[k].reply_to == first[k[0], turns[k[0], k[1] - 1]] for k in replies)
