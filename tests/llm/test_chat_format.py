import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import chat_format as op

TABLE = "conv_id bigint, turn bigint, role string, text string"
LOG = f"conv_id bigint, {op.LOG}"
tricky = st.text(st.sampled_from(list("<>[]\\/sINTSYROLE \n")), max_size=40) | st.lists(
    st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE x]", "[/ROLE]", "\\", "<", "[", "é"]),
    max_size=8,
).map("".join)
roles = st.sampled_from(["user", "assistant", "system", "", "tool", "a]b\n[/ROLE]", "[INST]"])


@given(tricky)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    inside = op.escape(text)
    assert op.unescape(inside) == text
    for control in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]"):
        assert control not in inside


@settings(max_examples=300)
@given(st.lists(st.tuples(roles, tricky), max_size=5))
def test_rendered_turns_parse_back(turns):
    formatted, want, at = "", [], 0
    for role, text in turns:
        turn, start, end = op.render(role, text)
        formatted += turn
        want.append((role, text, at + start, at + end))
        at += len(turn)
    assert [tuple(t) for t in op.parse(formatted)] == want


def test_foreign_text_fails():
    with pytest.raises(ValueError):
        op.parse("no mark")


def digest(rows):
    """Digests of final turns, conversation by conversation."""
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in of.items():
        turns.sort(key=lambda t: t[:2])
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        full = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        size = sum(len(op.render(r, t)[0]) for _, _, r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(full.encode()).hexdigest(), len(learned),
                    hashlib.sha256(learned.encode()).hexdigest(), size))
    return sorted(out, key=repr)


def digests(spark, log, tmp_path):
    path = str(tmp_path / "formatted")
    return op.read_digests(spark, path, op.write_formatted(log, path))


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table_rows():
    random.seed(9)
    bits = ["word ", "[/INST]", "</s>", "é", "\U0001f600", "\n", "\\", "<\\s>"]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(random.choice([1, 2, 7, 200])):
            role = random.choice(["user", "assistant", "system", "tool", None])
            rows.append((conv, turn, role, random.choice([None, "", "".join(random.choices(bits, k=random.randint(1, 300)))])))
    rows.append((3, None, "user", "no turn"))
    rows.append((5, -3, "assistant", "before"))
    return rows


def test_table_of_turns_comes_back(spark, tmp_path):
    rows = table_rows()
    random.shuffle(rows)
    table = spark.createDataFrame(rows, TABLE)
    log = op.turns_as_log(table)
    assert collected(digests(spark, log, tmp_path)) == digest(rows)


def test_small_pieces_and_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "TURNS_PER_PART", 3)
    monkeypatch.setattr(op, "CHARS_PER_ROW", 50)
    monkeypatch.setattr(op, "_BATCH_ROWS", 4)
    rows = table_rows()
    assert collected(digests(spark, op.turns_as_log(spark.createDataFrame(rows, TABLE)), tmp_path)) == digest(rows)


def plain_fold(events):
    """Final (role, text) per message, by applying its events one after another."""
    state = {}
    for conv, turn, message, seq, kind, role, text in sorted(events, key=lambda e: e[3]):
        old_role, old = state.get((conv, turn, message), ("", ""))
        new = {"message": text or "", "edit": text or "", "start": "", "regenerate": "", "delta": old + (text or "")}[kind]
        state[(conv, turn, message)] = (old_role if role is None else role, new)
    return state


def test_any_log_equals_plain_fold(spark, tmp_path):
    random.seed(2)
    kinds = ["message", "start", "delta", "delta", "delta", "edit", "regenerate"]
    events = [
        (random.randint(0, 9), random.randint(0, 4), random.randint(0, 1), seq, random.choice(kinds),
         random.choice([None, "user", "assistant"]), random.choice([None, "", "a", "[INST]", "bc "]))
        for seq in range(900)
    ]
    log = spark.createDataFrame(random.sample(events, len(events)), LOG).repartition(6)
    path = str(tmp_path / "formatted")
    schema = op.write_formatted(log, path)
    got = op.read_turns(spark, path, schema).orderBy("conv_id", "part", "piece", "position").collect()
    final = plain_fold(events)
    assert [(r.conv_id, r.role, r.text) for r in got] == [(k[0], *final[k]) for k in sorted(final)]
    assert all(r.learned == (r.role == "assistant") for r in got)


def test_loss_spans_cover_assistant_texts_only(spark, tmp_path):
    rows = [(1, 0, "user", "q </s>"), (1, 1, "assistant", "a [INST] b"), (1, 2, "assistant", ""), (1, 3, "user", "[/INST]")]
    part = op.format_log(op.turns_as_log(spark.createDataFrame(rows, TABLE))).first()
    cuts = [part.formatted[s.start : s.end] for s in part.loss]
    assert cuts == ["a [\\INST] b", ""] and part.n_turns == 4
    assert part.formatted == "[INST] q <\\/s> [/INST] a [\\INST] b</s> </s>[INST] [\\/INST] [/INST]"


def test_odd_rows(spark, tmp_path):
    wide = spark.createDataFrame([("x", 1, "user", "hi", 5, "p")], "conv_id string, turn int, role string, text string, part int, piece string")
    got = digests(spark, op.turns_as_log(wide), tmp_path).first()
    assert (got.conv_id, got.n_turns, got.formatted_chars) == ("x", 1, len("[INST] hi [/INST]"))
    twice = spark.createDataFrame([(1, 0, "user", "same")] * 3, TABLE)
    assert digests(spark, op.turns_as_log(twice), tmp_path / "b").first().n_turns == 3
    assert digests(spark, op.turns_as_log(twice.limit(0)), tmp_path / "c").count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        op.format_log(spark.createDataFrame([(1, 0, 0, 0, "nod", "user", "x")], LOG)).collect()


def test_very_long_text(spark, tmp_path):
    text = "[INST] long \U0001f600 " * 200_000
    rows = [(1, 0, "user", text), (1, 1, "assistant", text)]
    assert collected(digests(spark, op.turns_as_log(spark.createDataFrame(rows, TABLE)), tmp_path)) == digest(rows)
