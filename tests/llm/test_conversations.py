import hashlib
import random
import re
import zlib
from itertools import product

from panelscope.llm import conversation_repair
from panelscope.llm.conversation_repair import ByteStack, Repair, repair_reports, repaired_rows

TURNS = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        draw = zlib.crc32(key.encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return out


def judged(rows):
    """(turn, role, text, fault) of a conversation's rows in order."""
    seen, out = set(), []
    for _, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired) over all sequences of edits with at most three inserts in a place."""
    best = None
    fills = [list(p) for n in range(4) for p in product(["user", "assistant"], repeat=n)]

    def go(i, cost, audit, kept):
        nonlocal best
        if best and cost > best[0]:
            return
        if not PATTERN.fullmatch(initials := "".join(r[:1] for r, _ in kept)) and not re.fullmatch(r"s|s?(ua)*u", initials):
            return
        for fill in fills:
            now, done = [*kept, *((r, "") for r in fill)], audit + "I" * len(fill)
            price = cost + 3 * len(fill)
            if i == len(rows):
                if PATTERN.fullmatch("".join(r[:1] for r, _ in now)) and (best is None or (price, done) < best[:2]):
                    best = (price, done, now)
                continue
            _, role, text, fault = rows[i]
            go(i + 1, price + 4, done + "D", now)
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                if role:
                    go(i + 1, price + extra, done + "K", [*now, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, price + extra + 3, done + "R", [*now, (new, text)])

    go(0, 0, "", [])
    return best


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = judged([r for r in damaged(rows) if r[0] == conv])
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [sum(f == name for *_, f in own) for name in ("blank", "duplicate", "truncated")]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        cost, audit, kept = cheapest(own)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((conv, gaps, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def talk(n, seed=8):
    random.seed(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", None, "", "admin"]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "é?", "end. \x0b", "a\nb."]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(random.randrange(1, 5)):
            rows.append((conv, random.choice([turn, turn, turn, 7, None]), random.choice(roles), random.choice(texts)))
    return rows


def test_matches_brute_force(spark):
    rows = talk(120)
    rows += [rows[0]] * 2
    df = spark.createDataFrame(rows, TURNS)
    want = plain(rows)
    assert listed(repair_reports(df)) == want
    clashing = df.selectExpr("*", "1 AS conv", "2 AS kind", "3 AS place", "4 AS seen", "5 AS fault", "6 AS dropped", "7 AS nth", "8 AS copy", "9 AS no_turn")
    assert listed(repair_reports(clashing)) == want
    assert len({a for *_, a, _ in want}) > 20


def test_repaired_rows_are_what_was_hashed(spark):
    df = spark.createDataFrame(talk(60, 9), TURNS)
    reports = {r["conv_id"]: r for r in repair_reports(df).collect()}
    of = {conv: [] for conv in reports}
    for r in repaired_rows(df).orderBy("conv_id", "place").collect():
        of[r["conv_id"]].append(r)
    for conv, rows in of.items():
        text = "\n".join(f"{r['role']}:{r['text']}" for r in rows)
        assert hashlib.sha256(text.encode()).hexdigest() == reports[conv]["repaired_sha256"]
        assert PATTERN.fullmatch("".join(r["role"][:1] for r in rows))
        assert "".join(r["edit"] for r in rows) == reports[conv]["audit"].replace("D", "")


def test_empty_table_and_dropped_conversations(spark):
    assert repair_reports(spark.createDataFrame([], TURNS)).count() == 0
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = repair_reports(spark.createDataFrame([(conv, 0, "user", "Hi.")], TURNS)).first()
    assert tuple(got) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_conversation_over_many_batches_and_a_spilled_stack(spark, monkeypatch):
    """The state outlives Arrow batches: small batches give what large ones do."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"line {i}." + " long" * (9000 if i == 50 else 0) + "!") for i in range(3000)]
    df = spark.createDataFrame(rows, TURNS)
    want = listed(repair_reports(df))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert listed(repair_reports(df)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    own = judged(damaged(rows))
    code = {None: 0, "blank": 1, "duplicate": 2, "truncated": 3}
    for limit in (1 << 20, 100, 2):
        one = Repair(spill=limit)
        for _, role, _, fault in reversed(own):
            one.judge(role[:1], code[fault])
        assert len(one.pointers.top) <= limit + 1
        for turn, role, text, fault in own:
            one.follow(turn, role, text, code[fault])
        assert (1, *one.finish()) == want[0]


def test_stack(tmp_path):
    stack, plain_stack = ByteStack(limit=8), []
    random.seed(1)
    for _ in range(5000):
        if plain_stack and random.random() < 0.4:
            assert stack.pop() == plain_stack.pop()
        else:
            plain_stack.append(random.randrange(256))
            stack.push(plain_stack[-1])
    assert [stack.pop() for _ in plain_stack] == plain_stack[::-1]
    stack.close()


def test_one_shuffle(spark):
    plan = repair_reports(spark.createDataFrame(talk(5), TURNS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and conversation_repair.SPILL > 0
