"""Chat formatting against a plain fold of the log, and round trips of odd texts."""

import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from newsweft.llm import chat

LOG = "conv_id long, turn long, message long, seq long, kind string, role string, text string, formatted string, whole int"
PIECES = ["a", "\\", "#", "##", "###", "<turn>", "</turn>", "</turn>\n", "<turn>### assistant\n", "\n", "é🙂", "<", "/turn>", ""]


def digest(rows):
    """(n_turns, sha of turns, loss characters, sha of loss) of (role, text) rows."""
    turns, loss = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows), "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def plain_fold(events):
    """(conv, turn, message) -> (role, text) after all events in order."""
    held = {}
    for conv, turn, message, _, kind, role, text in sorted(set(events), key=lambda e: (tuple((x is not None, x or 0) for x in e[:4]), str(e[4:]))):
        key, text = (conv, turn, message), text or ""
        if kind == "open":
            held[key] = [role or "", text]
        elif key in held:
            if kind == "delta":
                held[key][1] += text
            elif kind in ("edit", "regenerate"):
                held[key][1] = text if kind == "edit" else ""
            elif kind == "retract":
                del held[key]
    return held


def results(segments):
    return {r["conv_id"]: tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) for r in chat.read_back(segments).collect()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES)).map("".join), st.lists(st.sampled_from(PIECES)).map("".join))
def test_any_role_and_text_come_back(role, text):
    turned, a, b = chat.render_turn(role, text)
    found = chat.TURN.fullmatch(turned)
    assert (chat.unescape(found[1]), chat.unescape(found[2])) == (role, text)
    assert chat.unescape(turned[a:b]) == text
    shown = chat.ESCAPED.sub("~", turned[a:b])
    assert not any(mark in shown for mark in ("###", "<turn>", "</turn>"))


def test_fold_against_the_plain_one(spark, tmp_path):
    rnd = random.Random(7)
    events = []
    for conv in (1, 2, 3, None):
        for turn in (0, 1, 2, None):
            for message in range(rnd.randint(1, 2)):
                for seq in range(rnd.randint(1, 9)):
                    kind = rnd.choice(["open", "open", "delta", "delta", "delta", "edit", "regenerate", "retract", "other"]) if seq else rnd.choice(["open", "open", "delta"])
                    role = rnd.choice(["user", "assistant", None]) if kind == "open" else None
                    events.append((conv, turn, message, seq, kind, role, rnd.choice([None, "", *PIECES])))
    events += rnd.sample(events, 10)  # delivered twice
    held = plain_fold(events)
    rnd.shuffle(events)
    log = spark.createDataFrame([(*e, "f", 1) for e in events], LOG)
    got = {(r["conv_id"], r["turn"], r["message"]): (r["role"], r["text"]) for r in chat.fold(log).collect()}
    assert got == {k: tuple(v) for k, v in held.items()}
    want = defaultdict(list)
    for (conv, turn, message), (role, text) in sorted(held.items(), key=lambda e: tuple((x is not None, x or 0) for x in e[0])):
        want[conv].append((role, text))
    for size in (1, 40, chat.SEGMENT):  # a turn each, cut conversations, whole ones
        chat.write_formatted(log, str(tmp_path / f"f{size}"), size)
        assert results(chat.read_formatted(spark, str(tmp_path / f"f{size}"))) == {c: digest(rows) for c, rows in want.items()}
    assert chat.fold(log.limit(0)).collect() == [] and results(chat.render(chat.fold(log.limit(0)))) == {}


def test_conversations_come_back(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(c, t, rnd.choice(["user", "assistant", "system"]), "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 9))) * rnd.choice([1, 1, 600])) for c in range(40) for t in range(rnd.randint(1, 9))]
    rows += [(99, t, ["user", "assistant"][t % 2], f"line {t} ###") for t in range(800)]  # a hot one
    rows += [(100, 0, "user", None), (100, 1, None, "x"), (None, 0, "assistant", "y"), (101, 0, "user", "same"), (101, 0, "user", "same")]
    shuffled = rnd.sample(rows, len(rows))
    table = spark.createDataFrame([(*r, "e", "s") for r in shuffled], "conv_id long, turn long, role string, text string, events string, seq string").repartition(5)
    log = chat.event_log(table)
    kinds = {r["kind"] for r in log.select("kind").distinct().collect()}
    assert {"open", "delta", "edit", "regenerate"} <= kinds
    chat.write_formatted(log, str(tmp_path / "f"), 2000)
    want = defaultdict(list)
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want[conv].append((role, text))
    assert results(chat.read_formatted(spark, str(tmp_path / "f"))) == {c: digest(r) for c, r in want.items()}
