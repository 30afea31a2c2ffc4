import re

import pytest

from tapline.operators import badlines

LABEL = re.compile(r"[A-Za-z0-9_](?:[A-Za-z0-9_-]{0,61}[A-Za-z0-9_])?\Z")


def brute(line):
    """The rules, read one after another."""
    if line is None:
        return None
    line = line.strip(" \t")
    if not line or line.startswith("#"):
        return None
    if line.count('"') % 2:
        return "quoting"
    fields, now, quoted = [], "", False
    outside = "".join(p for i, p in enumerate(line.split('"')) if i % 2 == 0)
    seps = "," if "," in outside else " \t"
    for i, c in enumerate(line):
        if c == '"':
            quoted = not quoted
        if c in seps and not quoted:
            if seps == "," or i == 0 or line[i - 1] not in seps or now:
                if seps == "," or now:
                    fields.append(now)
                now = ""
            continue
        now += c
    fields.append(now)
    fields = [f.strip(" \t") for f in fields]
    if any('"' in f and not re.fullmatch(r'"[^"]*"', f, re.S) for f in fields):
        return "quoting"
    if len(fields) != 2:
        return "columns"
    fields = [f[1:-1].strip(" \t") if f.startswith('"') else f for f in fields]

    def ip(x):
        p = x.split(".")
        return len(p) == 4 and all(re.fullmatch("0|[1-9][0-9]{0,2}", q) and int(q) < 256 for q in p)

    if not any(map(ip, fields)):
        return "ip"
    name = fields[1] if ip(fields[0]) else fields[0]
    name = name[:-1] if name.endswith(".") else name
    labels = name.split(".")
    good = len(labels) > 1 and len(name) <= 253 and all(LABEL.match(x) for x in labels) and not labels[-1].isdigit()
    return "ok" if good else "dns"


LINES = [
    None, "", "   \t", "# note", "10.0.0.1,a.example", "a.example 10.0.0.1", "a.example\t \t10.0.0.1", '"a.example" " 10.0.0.1 "', '" 10.0.0.1 ",a.b', '10.0.0.1,"a.b', '10.0.0.1,a"b"c', '10.0.0.1,"a"."b"',
    "10.0.0.1,a.b,", ",10.0.0.1", "10.0.0.1,", "10.0.0.1 a.b c", "10.0.0.1;a.b", "10.0.0.256,a.b", "010.0.0.1,a.b", "10.0.0,a.b", "a.b,c.d", "10.0.0.1,10.0.0.2", "10.0.0.1,a", "10.0.0.1,a.b.", "10.0.0.1,a.b..", "10.0.0.1,-a.b",
    "10.0.0.1,a-.b", "10.0.0.1,a.9", "10.0.0.1,a.9.", "10.0.0.1,a.9b", "10.0.0.1,_a._b", "10.0.0.1,ä.b", f"10.0.0.1,{'a' * 63}.b", f"10.0.0.1,{'a' * 64}.b", "10.0.0.1," + ".".join(["a" * 49] * 5) + ".abc", "10.0.0.1," + ".".join(["a" * 49] * 5) + ".abcd",
    "10.0.0.1," + "a" * 100_000, '"10.0.0.1","a,b"', '"a b" 10.0.0.1', '"","10.0.0.1"', '"" ""', ",", '","', '" # " 10.0.0.1', "10.0.0.1\x01a.b", "10.0.0.1,a.b\\", "10.0.0.1,\x02", "10.0.0.1, a.b ,x", "10.0.0.1 , a.b",
]


def test_reasons_agree_with_rules(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "line_id bigint, line string")
    got = {r.line_id: r.reason for r in badlines.failed_lines(df).collect()}
    loaded = {r.line_id for r in badlines.valid_pairs(df).collect()}
    want = {i: brute(line) for i, line in enumerate(LINES)}
    assert got == {i: w for i, w in want.items() if w not in (None, "ok")}
    assert loaded == {i for i, w in want.items() if w == "ok"}


def test_random_lines(spark):
    import random

    rng = random.Random(5)
    pieces = ["10.0.0.1", "1.2.3.400", "a.example", "b-.x", "_c.d", '"', '""', ",", " ", "\t", ",", " ", '"10.0.0.9"', '" z.example "', "#", ".", "é"]
    lines = ["".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, line string")
    got = {r.line_id: r.reason or "ok" for r in badlines.read_lines(df).collect()}
    want = {i: w for i, line in enumerate(lines) if (w := brute(line)) is not None}
    assert got == want, [(lines[i], got.get(i), want.get(i)) for i in set(got) | set(want) if got.get(i) != want.get(i)][:5]


def test_values_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, ' "A.Example." , 10.0.0.1', "x")], "line_id bigint, line string, reason string")
    row = badlines.valid_pairs(df).collect()[0]
    assert (row.ip, row.dns) == ("10.0.0.1", "A.Example.")
    assert badlines.read_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("reason", badlines.REASONS)
def test_every_reason_occurs(spark, reason):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "line_id bigint, line string")
    assert badlines.failed_lines(df).filter(f"reason = '{reason}'").count() > 0


def test_very_many_fields(spark):
    lines = ["," * 2_000_001, "x " * 400_000 + "y", '"a",' * 70_000 + '"', "1.2.3.4,a.example" + "," * 15, "1.2.3.4,a.example"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, line string")
    got = {r.line_id: r.reason for r in badlines.read_lines(df).select("line_id", "reason").collect()}
    assert got == {0: "columns", 1: "columns", 2: "quoting", 3: "columns", 4: None}
