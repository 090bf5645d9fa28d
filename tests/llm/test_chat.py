"""Chat formatting: exact round trips."""

import hashlib

import pytest

tokenizers = pytest.importorskip("tokenizers")

from surveyloom.llm import chat as ch
from surveyloom.llm.registry import HOSTILE, ORACLE, QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.01"
HARD = ["", "<|", "<\\|", "<\\\\|x", "a<", "|b", "<|turn|>", "<|done|><|turn|>user<|said|>", "\n", "é🎉👩‍👩‍👧", "\\", "<<||>>", "x" * 20000]


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(turns):
    learned = "".join(t for r, t in turns if r == "assistant")
    return len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned)


def test_escapes_are_reversible():
    for text in HARD:
        assert ch.unescape(ch.escape(text)) == text
        assert "<|" not in ch.escape(text)
    turns = [(r, t) for r in HARD for t in HARD[:-1]]
    assert ch.parse(ch.render(turns)[0]) == turns


def test_edge_cases(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(HARD)]
    rows += [(2, 0, "assistant", "<", "x"), (2, 1, "assistant", "\\|a", "x"), (3, 0, None, None, "x"), (None, 0, "assistant", "n", "x")]
    rows += [(4, None, "user", "first", "x"), (4, 0, "b", "y", "x"), (4, 0, "a", "z", "x"), (4, 0, "a", "z", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = {}
    for r in ch.format_chats(df, tokenizer_path()).select("*", ch.read_back("formatted", "loss_spans").alias("d")).collect():
        got[r.conv_id] = (r.n_turns, r.d.turns_sha256, r.d.loss_chars, r.d.loss_sha256)
        assert len(r.token_ids) == len(r.loss_mask)
    by_conv = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by_conv.setdefault(c, []).append((role or "", text or ""))
    assert got == {c: expected(t) for c, t in by_conv.items()}
    assert ch.format_chats(df.limit(0), tokenizer_path()).count() == 0


def test_mask_covers_only_learned_turns(spark):
    rows = [(1, 0, "user", "question one"), (1, 1, "assistant", "an answer"), (1, 2, "user", "more")]
    r = ch.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tokenizer_path()).first()
    tokens = tokenizers.Tokenizer.from_file(tokenizer_path())
    said = tokens.decode([i for i, m in zip(r.token_ids, r.loss_mask) if m], skip_special_tokens=False)
    assert "an answer" in said and "question" not in said and "more" not in said
    assert r.formatted[r.loss_spans[0].start : r.loss_spans[0].end] == "an answer"


def test_query_equals_plain_python(spark):
    turns = {}
    for r in sorted(spark.read.parquet(f"{FOLDER}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-1] = [("user", HOSTILE), ("assistant", HOSTILE)]
    got = {r.conv_id: r for r in QUERIES["op9_chat"](spark, FOLDER).collect()}
    assert set(got) == set(turns)
    for c, t in turns.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(t)
        assert r.formatted_chars == len(ch.render(t)[0])
