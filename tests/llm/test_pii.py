import random
import re

from pyspark.sql import functions as F

from latewise.llm.pii import KINDS, as_text, find_personal_data, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_rule_spans_equal_brute_force_and_trees_add_more(spark):
    random.seed(2)
    bits = ["1", "2", "9", ".", "@", "a", "é", "-", " ", "+", "(", ")", "b.c", "%", "_", "4111 1111 1111 1111", "00",
            "255", "1.2.3.4", "😀"]
    rows = [(i, "".join(random.choice(bits) for _ in range(random.randint(0, 60)))) for i in range(600)]
    rows += [(None, None), (1, ""), (2, "1" * 20_000), (3, "a" * 20_000 + "@"), (4, "1 " * 10_000), (4, "1 " * 10_000)]
    for i in range(200):
        number = f"({i:03d}) 555-{7 * i % 10_000:04d}"
        secret = f"{random.getrandbits(160):040x}"
        rows.append((10_000 + i, f"call +1 {number} now, token = \"{secret}\" é"))
    rows += [(20_000, "words (417) 555-1234 words"), (20_001, f"é {random.getrandbits(160):040x} here"),
             (20_002, "on 2024-01-15 10:30:12 we paid 12 345 678 for version 1.22.333 of it"),
             (20_003, "plain words without anything " * 50)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rules string")
    found = find_personal_data(df).select("id", as_text(F.col("rules")).alias("r"), as_text(F.col("added")).alias("a"))
    got = found.collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.id, r.r) for r in got), key=key) == sorted(((i, brute(t)) for i, t in rows), key=key)
    added = {r.id: r.a for r in got if r.id is not None and r.id >= 10_000}
    assert added[20_001].startswith("secret:2:") and added[20_000].startswith("phone:6:")
    assert added[20_002] == "" and added[20_003] == ""
    assert all(added[10_000 + i].startswith("secret:") for i in range(200))


def test_redact_and_empty_table(spark):
    spans = F.array(*[F.struct(F.lit(KINDS.index(k)).alias("kind"), F.lit(a).cast("long").alias("start"),
                               F.lit(b).cast("long").alias("end")) for k, a, b in (("ip", 2, 4), ("email", 3, 6), ("card", 8, 9))])
    assert spark.range(1).select(redact(F.lit("é1234567é9"), spans).alias("t")).first().t == "é1[removed]67[removed]9"
    assert find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spelled_out_and_ipv6_addresses_are_selected_and_their_decoys_are_not(spark):
    """No rule and no sign labels any of these; the second corpus has rule e-mails, the first has nothing."""
    personal = {
        1: ("email", "john at example dot com"), 2: ("email", "m.weber (at) acme (dot) org"),
        3: ("email", "anna at mail7 dot example dot com"), 4: ("ip", "2001:db8:0:0:1:2:3:4"),
        5: ("ip", "FE80:0:0:0:202:B3FF:FE1E:8329"), 6: ("ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
        7: ("phone", "(417) 555-1234"), 8: ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
    }
    decoy = ["look at the dot on", "stare at that dot in", "look at 3fa2b dot point", "met at noon dot then",
             "12:34:56:07", "00:1b:44:11:3a:b7", "50:06:01:60:3b:a0:11:22", "4:8:15:16:23", "2024-01-15 10:30:12",
             "a-very-long-chapter-name-7-of-this-book"]
    rows = [(i, f"see {x} and more") for i, (_, x) in personal.items()]
    rows += [(100 + i, f"we {x} the page") for i, x in enumerate(decoy)]
    mails = [(1000 + i, f"write to u{i}.{i % 7}@mail{i % 9}.example.com today") for i in range(300)]
    for given in (rows, rows + mails):
        found = find_personal_data(spark.createDataFrame(given, "doc_id long, text string"))
        spans = found.select("id", as_text(F.col("rules")).alias("r"), as_text(F.col("added")).alias("a"))
        got = {r.id: (r.r, r.a) for r in spans.collect()}
        want = {i: ("", f"{kind}:4:{4 + len(x)}") for i, (kind, x) in personal.items()}
        want |= {100 + i: ("", "") for i in range(len(decoy))}
        assert {i: got[i] for i in want} == want


def test_trees_and_thresholds_see_every_rule_email_and_score(spark):
    from latewise.llm.pii import _thresholds, propose, spelled_out

    mails = spark.createDataFrame([(i, f"write to u{i}@mail{i % 9}.example.com today") for i in range(4_100)], "doc_id long, text string")
    assert spelled_out(propose(mails)).count() == 4_100
    rows = [("phone", 0.9, 1.0, 0.5)] * 4 + [("phone", 0.8, 0.0, 1.0)] + [("phone", 0.7, 1.0, 0.5)] * 300 + [("ip", 0.9, 0.0, 1.0)]
    scored = spark.createDataFrame(rows, "generator string, score double, label double, weight double")
    # By weight 152 of 153 are positive down to 0.7, and the first four alone.
    assert [tuple(r) for r in _thresholds(scored, 0.99).collect()] == [("phone", 0.7)]
    assert [tuple(r) for r in _thresholds(scored, 0.995).collect()] == [("phone", 0.9)]
