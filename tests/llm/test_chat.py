import hashlib
import random

from provenant.llm import chat
from provenant.llm.common import tokenizer_file
from provenant.session import new_run_dir

MODEL = tokenizer_file("byte_bpe_50k.json")


def _rows(seed):
    rng = random.Random(seed)
    texts = ["hi", "", "<|im_end|>", "a\\b <| \\| <\\|", "línea\n\n", "<|endoftext|> x", None, "日本 \\", "word " * 3000]
    rows = []
    for conv in range(60):
        start = rng.choice([0, 0, 5])
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, start + turn, ["user", "assistant", "sys\ntem\\", None][turn % 4], rng.choice(texts[: 2 + turn])))
    rows += [(c, t, r, x) for c in (100, 101) for _, t, r, x in rows if _ == 7]
    rows += [(200, 0, "user", "same"), (200, 0, "user", "same"), (200, None, "assistant", "first"), (None, 0, "assistant", "no id")]
    rng.shuffle(rows)
    return rows


def _want(rows):
    out, held = {}, {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in held.items():
        turns.sort()
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
        size = sum(len(f"{chat.START}{chat.escape_role(r)}\n{chat.escape(t)}{chat.END}") for _, _, r, t in turns)
        out[conv] = (len(turns), digest, len(learned), hashlib.sha256(learned.encode()).hexdigest(), size)
    return out


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choices("<|\\n\nx", k=rng.randint(0, 9)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        assert "\n" not in chat.escape_role(text) and chat.unescape_role(chat.escape_role(text)) == text


def test_trees(spark):
    rows = _rows(3)
    folder = new_run_dir(spark, "test-chat")
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, start int")
    chat.write(table, folder, MODEL)
    got = {r.conv_id: tuple(r)[1:] for r in chat.read(spark, folder, MODEL).collect()}
    assert got == _want(rows)

    nodes = sorted(spark.read.parquet(f"{folder}/nodes").collect(), key=lambda r: r.start)
    ways = {r.conv: r.runs for r in spark.read.parquet(f"{folder}/conversations").collect()}
    assert len(nodes) < len(rows)
    # The stream has no gaps, and each node's ancestors and positions are those of its conversation.
    assert [n.start for n in nodes] == [0, *(n.end for n in nodes[:-1])]
    at = {(n.rep, n.depth): n for n in nodes}
    for runs in ways.values():
        line = [at[r.rep, d] for r in runs for d in range(r.first, r.last + 1)]
        assert [n.depth for n in line] == list(range(len(line)))
        for k, node in enumerate(line):
            before = {p for n in line[:k] for p in range(n.start, n.end)}
            assert {p for i in node.attends for p in range(i.start, i.end)} == before
            assert node.position == len(before)
    # Depth first: what lies between a node and the next one not below it has it as an ancestor.
    stack = []
    for node in nodes:
        del stack[node.depth :]
        assert len(stack) == node.depth
        assert {p for i in node.attends for p in range(i.start, i.end)} == {p for n in stack for p in range(n.start, n.end)}
        stack.append(node)


def test_no_conversations(spark):
    folder = new_run_dir(spark, "test-chat")
    chat.write(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), folder, MODEL)
    assert chat.read(spark, folder, MODEL).count() == 0
