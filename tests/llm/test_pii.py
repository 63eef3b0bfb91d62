"""Pseudonyms against a plain implementation, and their properties."""

import datetime
import hashlib
import re

from pyspark.sql import functions as F

from roadloom.llm import pii

KEY = "k'1"


def number(kind, i, half, size=0):
    return int(hashlib.sha256("|".join(map(str, (KEY, kind, size, i, half))).encode()).hexdigest()[:13], 16)


def digits(d, kind):
    u, v = len(d) // 2, len(d) - len(d) // 2
    a, b = int(d[:u]), int(d[u:])
    for i in range(pii.ROUNDS):
        a, b = b, (a + number(kind, i, b, len(d))) % 10 ** (v if i % 2 else u)
    return str(a).zfill(u) + str(b).zfill(v)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))


def refill(m, d):
    it = iter(d)
    return re.sub("[0-9]", lambda _: next(it), m)


def one(m):
    only = re.sub("[^0-9]", "", m)
    if "@" in m:
        k = m.index("@")
        return hashlib.sha256(f"{KEY}|email|{m.lower()}".encode()).hexdigest()[: min(64, max(16, k))] + m[k:]
    if re.match("[a-z]", m):
        h = re.match(r"[a-z_]+[ \t]*[:=][ \t]*[\"']?", m)[0]
        r = m[len(h) :]
        return h + hashlib.sha256(f"{KEY}|secret|{r}".encode()).hexdigest()[: min(64, max(8, len(r)))]
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return m
        a, b = o[0] * 256 + o[1], o[2] * 256 + o[3]
        for i in range(pii.ROUNDS):
            a, b = b, a ^ (number("address", i, b) & 65535)
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    if re.fullmatch(r"\d{4}[-/]\d\d[-/]\d\d|\d\d[./]\d\d[./]\d{4}", m):
        for fmt in (f"%Y{m[4]}%m{m[7]}%d",) if m[:4].isdigit() else (f"%d{m[2]}%m{m[5]}%Y", f"%m{m[2]}%d{m[5]}%Y"):
            try:
                d = datetime.datetime.strptime(m, fmt).date()
            except ValueError:
                continue
            e = datetime.date(200 + 400 * ((d.year - 200) // 400), 1, 1)
            a, b = divmod((d - e).days, 773)
            for i in range(pii.ROUNDS):
                if i % 2 == 0:
                    a = (a + number("date", i, b)) % 189
                else:
                    b = (b + number("date", i, a)) % 773
            return (e + datetime.timedelta(a * 773 + b)).strftime(fmt)
        return m
    if m[0] in "+(" or re.fullmatch(r"\d{3}-\d{3}-\d{4}", m):
        c = 0
        if m[0] == "+":
            two = {*"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
            c = 1 if only[0] in "17" else 2 if only[:2] in two else 3
        return refill(m, only[:c] + digits(only[c:], "phone"))
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        x, y, z = map(int, m.split("-"))
        if x in (0, 666) or x > 899 or not y or not z:
            return m
        a, b = x - 1 - (x > 666), (y - 1) * 9999 + z - 1
        for i in range(pii.ROUNDS):
            if i % 2 == 0:
                a = (a + number("ssn", i, b)) % 898
            else:
                b = (b + number("ssn", i, a)) % (99 * 9999)
        return f"{a + 1 + (a >= 665):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
    if luhn(only) % 10:
        return m
    q = digits(only[:-1], "card")
    return refill(m, q + str(-luhn(q + "0") % 10))


TEXTS = [
    None,
    "",
    "nothing here, 2.0 and 1,234",
    "write Réeux.34@mail7.example.com, or réeux.34@mail7.example.com.",
    "call +1 (017) 555-7713 or (212) 555-0199; card 4929348385146306, 4929 3483 8514 6306; no card 4929348385146307",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" password:hunter2hunter',
    "hosts 97.51.17.173 256.1.1.1 1.2.3.4.5 10.0.0.1.",
    "born 1984-02-29, 31.12.1999, 12/31/1999, 2023-02-30, 29.02.2023, ssn 123-45-6789 000-12-3456",
    "4111111111111111",
    "with \x01 marks 10.0.0.1\x01 and 10.0.0.2",
    "numbers 212-555-0199, +44 20 7946 0958, +442079460958 and 666-12-3456, 123-00-6789, 123-45-0000",
    "é" * 3000 + " 4111111111111111 " + "x@y " * 2000,
]


def test_against_plain(spark):
    import regex

    pattern = regex.compile(pii.PATTERN)
    want = [t if t is None else pattern.sub(lambda m: one(m[0]), t) for t in TEXTS]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "n int, text string")
    got = pii.pseudonymise(docs, KEY, count_col="found").orderBy("n").collect()
    assert [r["text"] for r in got] == want
    assert [r["found"] for r in got][:5] == [0, 0, 0, 2, 5]
    assert "4929348385146306" not in got[4]["text"] and "4929348385146307" in got[4]["text"]
    assert pii.pseudonymise(spark.createDataFrame([], "text string"), KEY).count() == 0


def test_permutation(spark):
    n = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    assert n.select(F.expr(pii.permuted_digits("d", pii._quote(KEY), "x")).alias("p")).distinct().where("length(p) = 4").count() == 10_000
    days = spark.sql("select date_format(d, 'yyyy-MM-dd') as text from (select explode(sequence(date'1800-01-01', date'2199-12-31')) as d)")
    assert pii.pseudonymise(days, KEY).distinct().count() == 146_097


def test_numbers_stay_apart(spark):
    """Social security numbers: valid ones go to valid ones, one to one; others stay, so none of both ever meet."""
    text = F.format_string("%03d-%02d-%04d", (F.col("id") * 7919 % 1000).cast("int"), (F.col("id") * 31 % 100).cast("int"), (F.col("id") % 10_000).cast("int"))
    valid = F.col("was").rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    numbers = spark.range(60_000).select(text.alias("text")).distinct().withColumn("was", F.col("text"))
    out = pii.pseudonymise(numbers, KEY).select("text", "was", valid.alias("ok")).cache()
    assert out.select("text").distinct().count() == out.count()
    assert out.where("not ok and text <> was").count() == 0 and out.where("ok and text rlike '^(000|666|9)|-00-|-0000$'").count() == 0
    assert out.where("ok and text = was").count() < 3


def test_phones_stay_linked(spark):
    """The same number in several ways of writing, with or without its country code."""
    ways = ["+1 (017) 555-7713", "+10175557713", "+1-017-555-7713", "(017) 555-7713", "017-555-7713"]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(ways)), "n int, text string"), KEY).orderBy("n").collect()]
    assert len({re.sub("[^0-9]", "", g)[-10:] for g in got}) == 1 and all(g != w for g, w in zip(got, ways))
    assert [re.sub("[0-9]", "0", g) for g in got] == [re.sub("[0-9]", "0", w) for w in ways] and all(g.startswith("+1") for g in got[:3])


def test_names_stay_apart(spark):
    names = spark.range(200_000).select(F.format_string("n%d@mail.example.com", "id").alias("text"))
    assert pii.pseudonymise(names, KEY).distinct().count() == 200_000


def test_key_and_columns(spark):
    import pytest

    docs = spark.createDataFrame([("10.0.0.1", 1, "x"), (None, None, None)], "text string, parts int, _parts string")
    out = pii.pseudonymise(docs, KEY, count_col="found")
    assert out.columns == [*docs.columns, "found"] and sorted((r["found"], r["parts"]) for r in out.collect()) == [(0, None), (1, 1)]
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, KEY, count_col="parts")
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) == 64
    spark.conf.set(pii.KEY_SETTING, "abc")
    assert pii.session_key(spark) == "abc"
    spark.conf.unset(pii.KEY_SETTING)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    import regex

    pattern = regex.compile(pii.PATTERN)
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, KEY).collect()}
    assert got == {r["doc_id"]: pattern.sub(lambda m: one(m[0]), r["text"]) for r in docs.collect()}


def test_secret_names(spark):
    """Names in any case and with a prefix, the values gone, the rest as it was."""
    planted = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("text").rlike(pii._PARTS["secret"])).select(F.upper("text").alias("text")).collect()
    value = re.compile(r"(?i:token|secret|password)[ \t]*[:=][ \t]*[\"']?([A-Z0-9_/+=.-]{8,})")
    texts = [r["text"] for r in planted] + ['TOKEN = "9233A8EC0011"', "Token: 9233A8EC0011", "PASSWORD=9233A8EC0011", "API_KEY='9233A8EC0011'", "export AWS_SECRET=9233A8EC0011;", "myApp.dbPassword: 9233A8EC0011", "Access_Key=9233A8EC0011"]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), KEY).orderBy("n").collect()]
    assert len(planted) > 5 and all(not set(value.findall(t)) & set(value.findall(g)) for t, g in zip(texts, got))
    for t, g in zip(texts[len(planted) :], got[len(planted) :]):
        head = t[: t.index("9233")]
        assert g.startswith(head) and "9233A8EC0011" not in g and len(g) == len(t)
    assert got[-1][-12:] == hashlib.sha256(f"{KEY}|secret|9233A8EC0011".encode()).hexdigest()[:12]


def cards(m):
    """The groups of a run that make up cards, replaced: the plain way."""
    only = re.sub("[^0-9]", "", m)
    new = lambda d: (lambda q: q + str(-luhn(q + "0") % 10))(digits(d[:-1], "card"))
    ok = lambda d: 13 <= len(d) <= 19 and luhn(d) % 10 == 0
    if ok(only):
        return refill(m, new(only))
    groups, out, i = re.findall("[0-9]+[ -]?", m), "", 0
    if len(groups) == 1:
        return m
    sizes = [len(g.strip(" -")) for g in groups]
    usual = lambda a, k: bool(re.fullmatch("1[3-9]|4-4-4-4(-3)?|4-6-[45]|4-4-4-1", "-".join(map(str, sizes[a : a + k]))))
    best = [max(((usual(a, k), k) for k in range(1, min(19, len(groups) - a) + 1) if ok(re.sub("[^0-9]", "", "".join(groups[a : a + k])))), default=None) for a in range(len(groups))]
    while i < len(groups):
        b = best[i]
        if b and (b[0] or not any(x and x[0] for x in best[i + 1 : i + b[1]])):
            v = "".join(groups[i : i + b[1]])
            out, i = out + refill(v, new(re.sub("[^0-9]", "", v))), i + b[1]
        else:
            out, i = out + groups[i], i + 1
    return out


def test_cards_in_runs(spark):
    import random

    rng = random.Random(1)
    runs = ["4111-1111-1111-1111 12/27", "4111 1111 1111 1111 123", "order 12 4111 1111 1111 1111", "12 34 56 78 90 11 4111 1111 1111 1111 12", "4929348385146306 123 4929348385146306", "1 378282246310005 2"]
    fuzz = []
    for _ in range(300):
        fuzz.append(rng.choice([" ", "-"]).join(rng.choice(["4111 1111 1111 1111", "3782 822463 10005", "4929348385146306", *(str(rng.randrange(10 ** (k - 1), 10**k)) for k in (1, 2, 3, 4, 5, 7))]) for _ in range(rng.randint(2, 8))))
    import regex

    want = [regex.sub(pii._PARTS["card"], lambda m: cards(m[0]), t) for t in runs + fuzz]
    df = spark.createDataFrame([(k, "." * 3 + " x " + t + " x") for k, t in enumerate(runs + fuzz)], "n int, text string")
    only = spark.createDataFrame(list(enumerate(runs + fuzz)), "n int, m string")
    got = [r["m"] for r in only.select("n", F.expr(f"case when m rlike '^[0-9][0-9 -]*$' then {pii._card(pii._quote(KEY))} else m end").alias("m")).orderBy("n").collect()]
    assert got[len(runs) :] == [cards(m) for m in fuzz]
    out = [r["text"] for r in pii.pseudonymise(df, KEY).orderBy("n").collect()]
    assert [o[6:-2] for o in out[: len(runs)]] == want[: len(runs)]
    for o in out[: len(runs)]:
        assert not any(c in re.sub("[^0-9]", "", o) for c in ("4111111111111111", "4929348385146306", "378282246310005"))
    assert out[2].startswith("... x order 12 ") and out[0].endswith(" 12/27 x") and out[1].endswith(" 123 x")


def test_values_after_cards(spark):
    """A run ends before another value, which is replaced on its own."""
    card = "4111 1111 1111 1111"
    other = ["123-45-6789", "2021-03-04", "31.12.1999", "97.51.17.173", "12345@mail.example.com", "4929348385146306"]
    texts = [f"{card} 12 {x}." for x in other] + ["3/7/2021", "2021-3-7", "7.12.2021", "29/2/2023", "03/07/2021"]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), KEY, count_col="found").orderBy("n").collect()]
    alone = dict(zip(other, (r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(other)), "n int, text string"), KEY).orderBy("n").collect())))
    assert got[: len(other)] == [f"{cards(card)} 12 {alone[x]}." for x in other]
    a, b, c, invalid, padded = got[len(other) :]
    day = datetime.datetime.strptime(padded, "%d/%m/%Y")
    assert a == f"{day.day}/{day.month}/{day.year}"
    back = one("2021-03-07").split("-")
    assert [int(x) for x in b.split("-")] == list(map(int, back)) and b != "2021-3-7" and c != "7.12.2021" and invalid == "29/2/2023"


def test_no_plan_has_the_key(spark):
    docs = spark.createDataFrame([(1, "mail a.b@example.com, card 4111 1111 1111 1111, 10.1.2.3")], "doc_id long, text string")
    out = pii.pseudonymise(docs, "topsecretkey123", count_col="n")
    for mode in ("simple", "extended", "codegen", "cost", "formatted"):
        assert "topsecret" not in out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
    assert out.collect()[0]["n"] == 3
    assert "topsecret" not in out._jdf.queryExecution().toString()
    assert pii.pseudonymise(docs, "other").collect() != pii.pseudonymise(docs, "topsecretkey123").collect()
