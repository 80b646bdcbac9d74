"""Format-preserving pseudonyms of validated numbers, dates, addresses and keys, by keyed Feistel permutations.

What is found (fixed patterns) and how it is checked:
  card   13 to 19 digits, or groups of 4-4-4-4, 4-6-5 or 4-6-4 with one kind of separator; Luhn's checksum. The payload is permuted, the check digit made anew.
  phone  +country and up to 15 digits in all, in groups or not, or without a country (ddd) ddd-dddd, ddd-ddd-dddd and ddd.ddd.dddd, with or without a 1 before; all digits after the country are permuted.
  ssn    ddd-dd-dddd in the issued ranges; permuted within them.
  date   yyyy-mm-dd (also before a T and a time, which stays), dd/mm/yyyy or dd.mm.yyyy, a day that exists in 1800..2199; permuted among those days
         (400 years are 189 x 773 days). What is no dd/mm/yyyy but mm/dd/yyyy is permuted among such (the days after the 12th, 9 x 9833).
  ip     four octets of 0..255; permuted as octets.
  ip6    eight groups, or fewer with one ::, in the global (2000::/3), local (fc00::/7) and link (fe80::/10) ranges. The first
         group stays, the other seven are permuted as numbers, so that all spellings agree, and written out.
  email  letters and digits of the local part are permuted, each within its kind.
  token  access keys by their public prefixes (AKIA, ASIA, AROA, AIDA, gh?_, AIza, sk_live_, sk_test_, xox?-), which stay; letters and
         digits of the rest are permuted, each within its kind.
  key    32 or more hexadecimal characters with both letters and digits, also after 0x; permuted by value, so that spellings in
         either case agree. Letters are capitals where the key has no small ones, and in mixed keys where a capital stood.
What fails its check stays as it is. A permutation is keyed by the secret, the kind and the length alone, and runs over
the digits without their separators: equal values get equal pseudonyms in every document, different values different ones.

The secret is an argument, and `secret` gives a session's: the setting spark.ledgerloom.pii.key or, where that is unset, a random one
that is made once in the shared folder and stays there, so that all runs that share the folder agree.

DataFrame functions only. Every repeated group is bounded or possessive, so that no text overflows the matcher's stack.

Defined cases: a null text stays null and counts 0; repeated rows give repeated rows; texts without matches come back
unchanged; extra columns are kept by `pseudonymised`, whatever their names: a count's column whose name is taken gets an
underscore after it; labels of a mail domain have at most 63 characters and there are at most 127; an empty table gives an empty result.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import get_text, put_new, shared_root

ROUNDS = 8
SETTING, KEY_FILE = "spark.ledgerloom.pii.key", "ledgerloom-pii.key"

# The patterns, in the order in which they are tried.
KEY = "(?:(?<![0-9A-Za-z])|(?<=(?<![0-9A-Za-z])0[xX]))(?=[a-fA-F]*+[0-9])(?=[0-9]*+[a-fA-F])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])"
EMAIL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}+\\.){1,126}[A-Za-z]{2,63}(?![A-Za-z])"
LOCAL = "(?<![0-9A-Za-z.+-])(?:1[ .-])?(?:\\([0-9]{3}\\)[ .-]?[0-9]{3}[ .-]|[0-9]{3}(?<ls>[.-])[0-9]{3}\\k<ls>)[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
# 8 to 15 digits after the plus, spelled out for a look-behind.
_COUNTED = "|".join("\\+[0-9]" + "[ .()-]{0,2}[0-9]" * n for n in range(7, 15))
ABROAD = "(?<![0-9A-Za-z])\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,5}\\)[ .-]?)?[0-9]{1,5}(?<as>[ .-])[0-9]{2,8}(?:\\k<as>[0-9]{2,5}){0,4}" + f"(?<={_COUNTED})" + "(?![0-9A-Za-z]|[./-][0-9])"
PHONE = "\\+[0-9]{1,3}[ .-]?\\([0-9]{3}\\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|" + ABROAD + "|(?<![0-9A-Za-z])\\+[0-9]{8,15}(?![0-9A-Za-z])|" + LOCAL
COUNTRY = "^(\\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3}))"
CARD = "(?<![0-9A-Za-z.-])(?:[0-9]{4}(?<cs>[ -])[0-9]{4}\\k<cs>[0-9]{4}\\k<cs>[0-9]{4}|[0-9]{4}(?<ca>[ -])[0-9]{6}\\k<ca>[0-9]{4,5}|[0-9]{13,19})(?![0-9A-Za-z])"
SSN = "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
DATE = "(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\\.[0-9]{2}\\.[0-9]{4})(?![0-9A-SU-Za-z/-]|T(?![0-9]))"
IP = "(?<![0-9A-Za-z.])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\\.[0-9])"
IP6 = "(?<![0-9A-Za-z:.])(?:[23][0-9a-fA-F]{3}|[fF][cCdD][0-9a-fA-F]{2}|[fF][eE][89abAB][0-9a-fA-F])(?::[0-9a-fA-F]{0,4}){2,7}(?![0-9A-Za-z:])"
PREFIX = "AKIA|ASIA|AROA|AIDA|gh[pousr]_|AIza|sk_(?:live|test)_|xox[abpr]-"
TOKEN = "(?<![0-9A-Za-z_-])(?:A(?:KIA|SIA|ROA|IDA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,251}|AIza[0-9A-Za-z_-]{35}|sk_(?:live|test)_[0-9A-Za-z]{16,247}|xox[abpr]-[0-9A-Za-z-]{10,250})(?![0-9A-Za-z_-])"
ANY = "|".join((KEY, EMAIL, TOKEN, IP6, PHONE, CARD, SSN, DATE, IP))
KINDS = ("card", "phone", "ssn", "date", "ip", "ip6", "email", "token", "key")
# Days in 400 Gregorian years, as a product.
DAYS, DAY_HIGH, DAY_LOW, DAY_ZERO = 146097, 189, 773, "1800-01-01"
# The days after a month's 12th in 400 Gregorian years, as a product, and in a month.
LATE_HIGH, LATE_LOW, LATE_MONTH = 9, 9833, 88497 / 4800


def _long(x: Column) -> Column:
    return x.cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: expressions inside lambdas are not shared otherwise."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def feistel(values: Column, radices: Column, key: str, tweak: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of mixed-radix digits (array<long>), by adding to each half, in turn, a hash of the other."""

    def run(x: Column) -> Column:
        n, half = F.size(x["v"]), F.ceil(F.size(x["v"]) / 2).cast("int")
        cut = F.struct(F.slice(x["v"], F.lit(1), half).alias("l"), F.slice(x["v"], half + 1, n - half).alias("r"), F.slice(x["m"], F.lit(1), half).alias("ml"), F.slice(x["m"], half + 1, n - half).alias("mr"), x["t"].alias("t"))
        return let(cut, walk)

    def stir(part: Column, radix: Column, other: Column, tweak_: Column, round_: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), tweak_, round_.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
        # Each block hashes the seed: a long one is hashed first, so that long values take linear time.
        brief = lambda s: F.when(F.length(s) > 1024, F.sha2(s, 256)).otherwise(s)
        blocks = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(part) - 1) / 8).cast("int")), lambda b: F.sha2(F.concat_ws("|", s, b.cast("string")), 256))
        word = lambda bs, i: F.conv(F.substring(F.element_at(bs, F.floor(i / 8).cast("int") + 1), (i % 8) * 7 + 1, F.lit(7)), 16, 10).cast("long")
        moved = let(let(let(seed, brief), blocks), lambda bs: F.transform(part, lambda x, i: (x + word(bs, i)) % F.element_at(radix, i + 1)))
        return F.when(F.size(part) == 0, part).otherwise(moved)

    def walk(c: Column) -> Column:
        start = F.struct(c["l"].alias("l"), c["r"].alias("r"))
        done = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, lambda s, k: F.when(k % 2 == 0, F.struct(stir(s["l"], c["ml"], s["r"], c["t"], k).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), stir(s["r"], c["mr"], s["l"], c["t"], k).alias("r"))))
        return let(done, lambda d: F.concat(d["l"], d["r"]))

    return let(F.struct(values.alias("v"), radices.alias("m"), tweak.alias("t")), run)


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, "[^0-9]", "")), _long)


def _refill(text: Column, digits: Column) -> Column:
    """The text with its digits replaced, in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    fill = lambda new: F.aggregate(_chars(text), start, lambda a, c: F.when(c.between("0", "9"), F.struct(F.concat(a["s"], F.element_at(new, a["n"] + 1).cast("string")).alias("s"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["n"].alias("n"))))["s"]
    return let(digits, fill)


def _same(values: Column, radix: int) -> Column:
    return F.transform(values, lambda _: F.lit(radix).cast("long"))


def _luhn_digit(payload: Column) -> Column:
    n = F.size(payload)
    sums = F.transform(payload, lambda x, i: F.when((n - i) % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.pmod(F.lit(10) - F.aggregate(sums, F.lit(0).cast("long"), lambda a, x: a + x) % 10, F.lit(10)).cast("long")


def _card(m: Column, key: str) -> Column:
    def new(digits: Column) -> Column:
        payload = F.slice(digits, F.lit(1), F.size(digits) - 1)
        moved = feistel(payload, _same(payload, 10), key, F.concat(F.lit("card"), F.size(digits).cast("string")))
        return let(moved, lambda p: F.concat(p, F.array(_luhn_digit(p))))

    return _refill(m, let(_digits(m), new))


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, COUNTRY, 1)
    rest = F.regexp_replace(m, COUNTRY, "")
    tweak = F.concat(F.lit("phone"), F.regexp_replace(country, "[^0-9]", ""))
    return F.concat(country, _refill(rest, let(_digits(rest), lambda d: feistel(d, _same(d, 10), key, tweak))))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, b).cast("long") for a, b in ((1, 3), (5, 2), (8, 4)))
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    spelled = lambda v: F.format_string("%03d-%02d-%04d", F.when(v[0] >= 665, v[0] + 2).otherwise(v[0] + 1), v[1] + 1, v[2] + 1)
    return let(feistel(values, F.array(*[F.lit(x).cast("long") for x in (898, 99, 9999)]), key, F.lit("ssn")), spelled)


def _day(m: Column) -> Column:
    text = F.when(F.substring(m, 5, 1) == "-", m).otherwise(F.concat(F.substring(m, 7, 4), F.lit("-"), F.substring(m, 4, 2), F.lit("-"), F.substring(m, 1, 2)))
    return text.try_cast("date")


def _month_first(m: Column) -> Column:
    """The day of mm/dd/yyyy after a 12th, which dd/mm/yyyy can't be; null for others."""
    text = F.when((F.substring(m, 3, 1) == "/") & (F.substring(m, 4, 2) > "12"), F.concat(F.substring(m, 7, 4), F.lit("-"), F.substring(m, 1, 2), F.lit("-"), F.substring(m, 4, 2)))
    return text.try_cast("date")


def _date(m: Column, key: str) -> Column:
    zero = F.lit(DAY_ZERO).cast("date")
    number = F.datediff(_day(m), zero).cast("long")
    values = let(number, lambda n: F.array(F.floor(n / DAY_LOW), n % DAY_LOW))
    moved = feistel(values, F.array(F.lit(DAY_HIGH).cast("long"), F.lit(DAY_LOW).cast("long")), key, F.lit("date"))
    pattern = F.when(F.substring(m, 5, 1) == "-", "yyyy-MM-dd").when(F.substring(m, 3, 1) == "/", "dd/MM/yyyy").otherwise("dd.MM.yyyy")
    day = lambda v: F.date_add(zero, (v[0] * DAY_LOW + v[1]).cast("int"))
    usual = let(moved, lambda v: F.call_function("date_format", day(v), pattern))
    # Days after the 12th are numbered without the twelve before them in each month.
    month = lambda d: (F.year(d) - 1800) * 12 + F.month(d) - 1
    late = let(_month_first(m), lambda d: (F.datediff(d, zero) - 12 * (month(d) + 1)).cast("long"))
    pair = let(late, lambda n: F.array(F.floor(n / LATE_LOW), n % LATE_LOW))
    shifted = feistel(pair, F.array(F.lit(LATE_HIGH).cast("long"), F.lit(LATE_LOW).cast("long")), key, F.lit("date-month-first"))
    before = lambda k: F.datediff(F.add_months(zero, k), zero) - 12 * k

    def spelled(n: Column) -> Column:
        guess = F.floor(n / LATE_MONTH).cast("int")
        return let(F.when(before(guess + 1) <= n, guess + 1).when(before(guess) <= n, guess).otherwise(guess - 1), lambda k: F.call_function("date_format", F.date_add(zero, (n + 12 * (k + 1)).cast("int")), F.lit("MM/dd/yyyy")))

    return F.when(_month_first(m).isNull(), usual).otherwise(let(let(shifted, lambda v: v[0] * LATE_LOW + v[1]), spelled))


def _ip(m: Column, key: str) -> Column:
    return let(F.transform(F.split(m, "\\."), _long), lambda o: F.array_join(F.transform(feistel(o, _same(o, 256), key, F.lit("ip")), lambda x: x.cast("string")), "."))


def _ip6_groups(m: Column) -> Column:
    """Eight numbers; null for what is no address."""
    halves = F.split(m, "::", -1)
    part = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":", -1))

    def whole(h: Column) -> Column:
        left, right = part(h[0]), F.when(F.size(h) == 2, part(F.get(h, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        lacking = 8 - F.size(left) - F.size(right)
        fits = F.when(F.size(h) == 1, lacking == 0).otherwise((F.size(h) == 2) & (lacking >= 1))
        return F.when(fits, F.concat(left, F.array_repeat(F.lit("0"), lacking), right))

    return let(let(halves, whole), lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9a-fA-F]{1,4}$")), F.transform(g, lambda x: F.conv(x, 16, 10).cast("long"))))


def _ip6(m: Column, key: str) -> Column:
    def new(g: Column) -> Column:
        rest = F.slice(g, F.lit(2), F.lit(7))
        return let(feistel(rest, _same(rest, 65536), key, F.concat(F.lit("ip6"), g[0].cast("string"))), lambda r: F.array_join(F.transform(r, lambda x: F.lower(F.hex(x))), ":"))

    return let(F.concat_ws(":", F.substring(m, 1, 4), let(_ip6_groups(m), new)), lambda out: F.when(m.rlike("[A-F]"), F.upper(out)).otherwise(out))


def _token(m: Column, key: str) -> Column:
    prefix = F.regexp_extract(m, f"^(?:{PREFIX})", 0)
    return F.concat(prefix, let(F.substring(m, F.length(prefix) + 1, F.length(m)), lambda rest: _spelled(rest, key, "token")))


def _spelled(text: Column, key: str, kind: str) -> Column:
    """Letters and digits permuted, each within its kind."""
    radix = lambda c: F.when(c.rlike("[0-9]"), F.lit(10)).when(c.rlike("[a-z]"), F.lit(26)).when(c.rlike("[A-Z]"), F.lit(27)).otherwise(F.lit(0))

    def value(x: Column) -> Column:
        at = F.ascii(x["c"])
        return (F.when(at < 58, at - 48).when(at < 91, at - 65).otherwise(at - 97)).cast("long")

    def letter(x: Column, v: Column) -> Column:
        return F.when(x["k"] == 10, F.char(v + 48)).when(x["k"] == 26, F.char(v + 97)).otherwise(F.char(v + 65))

    def spelled(chars: Column) -> Column:
        def fill(new: Column) -> Column:
            start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
            put = lambda a, x: F.when(x["k"] > 0, F.struct(F.concat(a["s"], letter(x, F.element_at(new, a["n"] + 1).cast("int"))).alias("s"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["s"], x["c"]).alias("s"), a["n"].alias("n")))
            return F.aggregate(chars, start, put)["s"]

        def moved(free: Column) -> Column:
            pattern = F.array_join(F.transform(free, lambda x: x["k"].cast("string")), ".")
            return feistel(F.transform(free, value), F.transform(free, lambda x: F.least(x["k"], F.lit(26)).cast("long")), key, F.concat(F.lit(kind), F.md5(pattern)))

        return let(let(F.filter(chars, lambda x: x["k"] > 0), moved), fill)

    return let(F.transform(_chars(text), lambda c: F.struct(c.alias("c"), radix(c).alias("k"))), spelled)


def _key(m: Column, key: str) -> Column:
    """Hexadecimal digits permuted by value."""
    spell = F.split(F.lit("0123456789abcdef"), "")

    def spelled(chars: Column) -> Column:
        values = F.transform(chars, lambda c: (F.ascii(c) - F.when(c < "a", 48).otherwise(87)).cast("long"))
        pattern = F.array_join(F.transform(chars, lambda _: F.lit("16")), ".")
        new = feistel(values, _same(values, 16), key, F.concat(F.lit("key"), F.md5(pattern)))
        return F.transform(new, lambda v: F.element_at(spell, (v + 1).cast("int")))

    def cased(new: Column) -> Column:
        mixed = let(_chars(m), lambda old: F.zip_with(old, new, lambda o, x: F.when(o.rlike("[A-F]"), F.upper(x)).otherwise(x)))
        text = F.array_join(new, "")
        return F.when(~m.rlike("[A-F]"), text).when(~m.rlike("[a-f]"), F.upper(text)).otherwise(F.array_join(mixed, ""))

    return let(let(_chars(F.lower(m)), spelled), cased)


def _email(m: Column, key: str) -> Column:
    return F.concat(_spelled(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def kind_of(m: Column) -> Column:
    """The kind of a match of ANY that passes its check; null for others."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    day = _day(m)
    area = F.substring(m, 1, 3)
    return (
        F.when(m.contains("@"), "email")
        .when(whole(TOKEN), "token")
        .when(whole(IP6), F.when(_ip6_groups(m).isNotNull(), "ip6"))
        .when(m.startswith("+") | whole(LOCAL), "phone")
        .when(whole(CARD) & F.call_function("luhn_check", F.regexp_replace(m, "[^0-9]", "")), "card")
        .when(whole(SSN) & ~area.isin("000", "666") & (area < "900") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000"), "ssn")
        .when(whole(DATE), F.when(F.coalesce(day, _month_first(m)).between(F.lit(DAY_ZERO).cast("date"), F.lit("2199-12-31").cast("date")), "date"))
        .when(whole(IP), F.when(F.forall(F.split(m, "\\."), lambda x: x.cast("int") < 256), "ip"))
        .when(whole(KEY), "key")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    made = {"card": _card, "phone": _phone, "ssn": _ssn, "date": _date, "ip": _ip, "ip6": _ip6, "email": _email, "token": _token}
    out = reduce(lambda a, k: a.when(kind == k, made[k](m, key)), made, F.when(kind == "key", _key(m, key)))
    return out.otherwise(m)


def secret(spark: SparkSession) -> str:
    """The session's key: its setting, or the one that the shared folder keeps."""
    given = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if given:
        return given
    path = f"{shared_root(spark)}/{KEY_FILE}"
    put_new(spark, path, secrets.token_hex(32).encode())
    return get_text(spark, path)


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in (x.lower() for x in taken):
        name += "_"
    return name


def pseudonymised(docs: DataFrame, key: str, text: str = "text", counts: bool = True) -> DataFrame:
    """The input with its text pseudonymised; with `counts` also n_<kind> columns and n_private, their sum."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    m, k = (_free(x, docs.columns) for x in ("__matches", "__kinds"))
    found = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    kinds = F.transform(m, lambda x: F.struct(x.alias("m"), kind_of(x).alias("k")))
    base = docs.withColumn(m, found).withColumn(k, F.when(F.size(m) > 0, kinds))
    has = F.exists(k, lambda x: x["k"].isNotNull())
    parts = F.split(F.col(text), ANY, -1)
    new = F.transform(k, lambda x: pseudonym(x["m"], x["k"], key))
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(parts.alias("p"), new.alias("q")), lambda x: F.array(F.coalesce(x["p"], F.lit("")), F.coalesce(x["q"], F.lit(""))))), "")
    kind_list = F.transform(k, lambda x: F.coalesce(x["k"], F.lit("")))
    many = {_free(f"n_{kind}", docs.columns): F.greatest(F.coalesce(F.size(kind_list) - F.size(F.array_remove(kind_list, kind)), F.lit(0)), F.lit(0)) for kind in KINDS} if counts else {}
    out = base.withColumns({text: F.when(F.coalesce(has, F.lit(False)), joined).otherwise(F.col(text)), **many}).drop(m, k)
    return out.withColumn(_free("n_private", docs.columns), reduce(lambda a, b: a + b, [F.col(c) for c in many])) if counts else out


def op6_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), secret(spark))
