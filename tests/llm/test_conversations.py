"""Structure repair and chat formatting against brute force, on conversations that are awkward in every way."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from llm import chat_format, structure_repair

COLUMNS = "conv_id long, turn long, role string, text string"


def awkward_turns() -> list[tuple]:
    """Nulls in every column, ties, repeated rows, gaps, unknown and empty roles, control strings, a very long text."""
    rng = random.Random(11)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "user\nx", "<turn>"]
    texts = ["Fine.", "Fine.", "Why?", "cut off", "  \t\n", "", None, "A \\ b </turn>\n c.", "### Assistant: <turn>user\n\\\\", "日本語。", "Ö😀!"]
    rows = [(conv, turn, rng.choice(roles), f"{rng.choice(texts) or ''}" if rng.random() < 0.3 else rng.choice(texts)) for conv in range(40) for turn in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "Hm."), (None, None, None, None), (50, None, "assistant", "Yes."), (50, None, "user", "Yes."), (50, 9, "user", "x")]
    rows += [(51, 3, "user", "Again."), (51, 3, "user", "Again."), (51, 3, "assistant", "Again."), (51, 70, "assistant", "Again.")]
    rows += [(52, 0, "user", "word \\ " * 400_000 + "."), (52, 1, "assistant", "</turn>\n" * 200_000)]
    return rows


@pytest.fixture(scope="module")
def turns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_turns(), COLUMNS).repartition(7)
    return df.withColumns({name: F.col("role") for name in ("fault", "damage", "copy", "step", "edit", "state", "loss", "cost", "gaps")})


def grouped(rows, missing):
    """Turns of each conversation in order, nulls first, with nulls replaced."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn, missing if role is None else role, missing if text is None else text))
    return {conv: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for conv, own in found.items()}


# 11 structure repair


def damage_by_force(rows):
    blank = lambda value: " " if value is None else value
    out = []
    for conv, turn, role, text in rows:
        role, text = blank(role), blank(text)
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def fault_of(role, text, seen):
    body = re.sub(r"[\x20\x09-\x0d]+\Z", "", text)
    if not body:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return None if body[-1] in ".!?" else "truncated"


def repair_by_force(rows):
    """(cost, edits, turns) of the best of all repairs of (role, text, fault), tried edit by edit."""
    best = None

    def go(at, out, edits, cost, inserted):
        nonlocal best
        kinds = "".join(turn[:1] for turn in out)
        if best is not None and cost > best[0] or not re.fullmatch("s?(ua)*u?", kinds):
            return
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", kinds) and (best is None or (cost, edits) < best[:2]):
            best = (cost, edits, out)
        if at < len(rows):
            role, text, fault = rows[at]
            go(at + 1, out, edits + "D", cost + 2, inserted)
            if fault not in ("blank", "duplicate"):
                stay = 5 if fault == "truncated" else 0
                if role[:1] and role[:1] in "sua":
                    go(at + 1, [*out, f"{role}:{text}"], edits + "K", cost + stay, inserted)
                for other in ("user", "assistant"):
                    go(at + 1, [*out, f"{other}:{text}"], edits + "R", cost + stay + 1, inserted)
        if inserted < 3:
            for role in ("user", "assistant"):
                go(at, [*out, f"{role}:"], edits + "I", cost + 5, inserted + 1)

    go(0, [], "", 0, 0)
    return best


def summary_by_force(rows):
    expected = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows}
    for conv, own in grouped(damage_by_force(rows), " ").items():
        seen, judged = set(), []
        for _, role, text in own:
            judged.append((role, text, fault_of(role, text, seen)))
            seen.add((role, text))
        known = {turn for turn, *_ in own if turn is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        faults = Counter(fault for *_, fault in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, edits, turns = repair_by_force(judged)
        digest = hashlib.sha256("\n".join(turns).encode()).hexdigest()
        expected[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, edits, digest)
    return expected


def test_repair_of_damaged_conversations(turns):
    rows = structure_repair.repair_damaged(turns).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == summary_by_force(awkward_turns())
    assert len(rows) == len({r[0] for r in rows})


def test_repair_gives_the_edits(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There?"), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "Yes.")]
    got = structure_repair.edits(spark.createDataFrame(rows, COLUMNS)).orderBy("step").collect()
    assert [(r["edit"], r["turn"], r["fault"], r["role"], r["text"], r["cost"]) for r in got] == [
        ("D", 0, None, None, None, 2),
        ("K", 1, None, "user", "There?", 0),
        ("K", 2, None, "assistant", "Yes.", 0),
        ("D", 3, "duplicate", None, None, 2),
    ]


def test_search_by_force():
    rng = random.Random(5)
    for _ in range(1500):
        roles = ["user", "user", "assistant", "assistant", "system", " ", "tool", ""]
        faults = [None, None, None, "blank", "duplicate", "truncated"]
        rows = [(rng.choice(roles), f"t{i}", rng.choice(faults)) for i in range(rng.randint(0, 6))]
        search, nodes = structure_repair.Repair(), []
        for i, (role, text, fault) in enumerate(rows):
            nodes += [(n.letter, n.role, n.row) for n in search.step(role[:1], (i, role, text, fault), fault in ("blank", "duplicate"), fault == "truncated")]
        cost, rest = search.finish()
        nodes += [(n.letter, n.role, n.row) for n in rest]
        turns = [f"{role}:{row[2] if row else ''}" for letter, role, row in nodes if letter != "D"]
        assert (cost, "".join(n[0] for n in nodes), turns) == repair_by_force(rows), rows


def test_search_holds_what_is_undecided():
    """A long conversation with faults is decided on the way; one that never is stays fast."""
    rng = random.Random(1)
    search, held, decided = structure_repair.Repair(), 0, 0
    for i in range(20_000):
        role = rng.choice(["user", "assistant", "system"])
        decided += sum(1 for _ in search.step(role[:1], (i, role, "x", None), rng.random() < 0.1, rng.random() < 0.1))
        held = max(held, *(s[1].depth - search.root.depth for s in search.best if s))
    assert held < 200 and decided > 19_700
    search = structure_repair.Repair()
    for i in range(20_000):
        assert not list(search.step("u", (i, "user", "x", None), False, False))
    assert search.finish()[0] == 10_000


def test_repair_of_nothing(turns):
    assert structure_repair.repair_damaged(turns.where("false")).count() == 0


# 13 chat formatting


def formatted_by_force(rows):
    marks = ["\\", "<turn>", "</turn>", "### System:", "### User:", "### Assistant:"]
    expected = {}
    for conv, own in grouped(rows, "").items():
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest()
        loss = "".join(text for _, role, text in own if role == "assistant")
        length = 0
        for _, role, text in own:
            escapes = sum(role.count(m) + text.count(m) for m in marks) + role.count("\n")
            length += len(f"<turn>{role}\n{text}</turn>\n") + escapes
        legal = {None: "su", "s": "u", "u": "a", "a": "u", "": "su"}
        kinds = [None] + [role[:1] if role in ("system", "user", "assistant") else "" for _, role, _ in own]
        illegal = sum(not b or b not in legal[a] for a, b in zip(kinds, kinds[1:], strict=False))
        expected[conv] = (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), length, illegal)
    return expected


def test_formats_are_read_back(turns):
    got = chat_format.digests(chat_format.with_control_case(turns)).collect()
    hard = "\\### Assistant: </turn> ok"
    rows = awkward_turns() + [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    assert {r[0]: tuple(r[1:7]) for r in got} == formatted_by_force(rows)
    complete = {r["conv_id"]: r["complete"] for r in got}
    assert complete[-7] and not complete[50]


def test_segments_of_a_template(spark):
    rows = [(1, 0, "user", "a <turn> b"), (1, 1, "assistant", "c"), (1, 2, "assistant", "d")]
    got = chat_format.segments(spark.createDataFrame(rows, COLUMNS)).orderBy("turn_no", "segment_no").collect()
    assert "".join(r["text"] for r in got) == "<turn>user\na \\<turn> b</turn>\n<turn>assistant\nc</turn>\n<turn>assistant\nd</turn>\n"
    assert [r["text"] for r in got if r["loss"]] == ["c", "d"]
    assert [r["legal"] for r in got if r["segment_no"] == 0] == [True, True, False]
    # Another template: other markers, the closing marker trained as well, and only two turns allowed.
    template = chat_format.Template(
        opening="[",
        role_end="|",
        closing="]",
        pattern=(("[{role}|", False), ("{text}", True), ("]", False)),
        escape="~",
        controls=("[", "]"),
        transitions={("start", "user"): "asked", ("asked", "assistant"): "answered"},
    )
    formatted = chat_format.segments(spark.createDataFrame([(1, 0, "us|er", "[~]"), (1, 1, "assistant", "]~~[")], COLUMNS), template)
    assert "".join(r["text"] for r in formatted.orderBy("turn_no", "segment_no").collect()) == "[us~|er|~[~~~]][assistant|~]~~~~~[]"
    read = chat_format.read_back(formatted, template).first()
    assert read["turns_sha256"] == hashlib.sha256(b"us|er\n[~]\nassistant\n]~~[\n").hexdigest() and read["loss_chars"] == 4


def test_formats_of_nothing(turns):
    assert chat_format.digests(turns.where("false")).count() == 0
