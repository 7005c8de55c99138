"""Hosts: numeric addresses in all the forms that browsers take, private ranges, mixed scripts, right-to-left names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posthound.plans.registry import Registry
from posthound.sources import adapters as src

R = Registry()


def ipv4_number(host: Column) -> Column:
    """The address that a host of one to four decimal, octal or hexadecimal parts means, as a number; null for names."""
    parts = F.split(F.lower(F.regexp_replace(host, r"\.$", "")), r"\.")
    n = F.size(parts)
    valid = (n <= 4) & F.forall(parts, lambda p: p.rlike(r"^(0x[0-9a-f]{0,8}|0[0-7]{0,11}|[1-9][0-9]{0,9})$"))

    def number(p: Column) -> Column:
        hexed = F.conv(F.when(F.length(p) > 2, F.substring(p, 3, 16)).otherwise("0"), 16, 10)
        return F.when(p.startswith("0x"), hexed).when(p.startswith("0"), F.conv(p, 8, 10)).otherwise(p).cast("long")

    nums = F.transform(parts, number)
    last = F.element_at(nums, -1)
    head = F.when(n > 1, F.slice(nums, 1, F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    room = F.pow(F.lit(256), 5 - n).cast("long")
    total = F.aggregate(F.transform(head, lambda v, i: v * F.pow(F.lit(256), 3 - i).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v) + last
    return F.when(valid & F.forall(head, lambda v: v <= 255) & (last < room), total)


def dotted(number: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(number, 8 * k) % 256).cast("string") for k in (3, 2, 1, 0)])


def is_private(number: Column) -> Column:
    top, two = F.shiftright(number, 24), F.shiftright(number, 16)
    return top.isin(0, 10, 127) | two.isin(169 * 256 + 254, 192 * 256 + 168) | F.shiftright(number, 20).isin(172 * 16 + 1)


def scripts(label: Column) -> Column:
    """How many of the Latin, Cyrillic and Greek scripts a label mixes."""
    return sum((label.rlike(rf"\p{{Is{s}}}").cast("int") for s in ("Cyrillic", "Greek")), label.rlike(r"\p{IsLatin}").cast("int"))


def shown_name(name: Column) -> Column:
    """A file name as a screen shows it: what follows a right-to-left override reads backwards, marks vanish."""
    at = F.instr(name, "‮")
    tail = F.regexp_replace(name.substr(at + 1, F.length(name)), "[‪-‮⁦-⁩].*$", "")
    rest = name.substr(at + 1 + F.length(tail), F.length(name))
    shown = F.concat(name.substr(F.lit(1), at - 1), F.reverse(tail), rest)
    return F.regexp_replace(F.when(at > 0, shown).otherwise(name), "[‪-‮⁦-⁩]", "")


_NUMBER = "(event_id * 2654435761 + user_id) % 4294967296"
_OCTET = lambda k: f"(n >> {8 * k}) % 256"


@R.add(
    f"""WITH e AS (SELECT event_id, CAST({_NUMBER} AS BIGINT) AS n FROM events), q AS (SELECT *, {_OCTET(3)} AS a, {_OCTET(2)} AS b, {_OCTET(1)} AS c, {_OCTET(0)} AS d FROM e)
SELECT event_id, a || '.' || b || '.' || c || '.' || d AS address, a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31) AS private FROM q WHERE event_id % 6 < 5"""
)
def host_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number of every event as a host in one of six spellings, the last of which is no address."""
    o = [F.expr(f"shiftright(n, {8 * k}) % 256") for k in (3, 2, 1, 0)]
    text = lambda c: c.cast("string")
    forms = [
        F.concat_ws(".", *map(text, o)),
        text(F.col("n")),
        F.concat(F.lit("0x"), F.lower(F.hex("n"))),
        F.concat_ws(".", *[F.concat(F.lit("0"), F.conv(text(x), 10, 8)) for x in o]),
        F.concat_ws(".", F.concat(F.lit("0X"), F.hex(o[0])), text(F.expr("n % 16777216"))),
        F.concat_ws(".", *map(text, o), F.lit("7")),
    ]
    form = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        form = F.when(F.col("event_id") % 6 == i, f).otherwise(form)
    rows = src.table(spark, sf_dir, "events").select("event_id", F.expr(f"cast({_NUMBER} as bigint)").alias("n")).select("event_id", form.alias("host"))
    rows = rows.withColumn("n", ipv4_number(F.col("host"))).filter("n is not null")
    return rows.select("event_id", dotted(F.col("n")).alias("address"), is_private(F.col("n")).alias("private"))


@R.add("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || 'exe.fdp' ELSE p_name || '.txt' END AS shown FROM part")
def rtlo_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other part's name hides its ending behind an override of the reading direction."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("\u202epdf.exe"))).otherwise(F.concat("p_name", F.lit(".txt")))
    return src.table(spark, sf_dir, "part").select("p_partkey", shown_name(name).alias("shown"))


@R.add("SELECT n_nationkey, [1, 2, 1, 0, 3][n_nationkey % 5 + 1] AS n FROM nation")
def mixed_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's name as it is, with a Cyrillic letter, as a Cyrillic word, as a number, and with letters of three alphabets."""
    name, k = F.lower("n_name"), F.col("n_nationkey")
    label = F.when(k % 5 == 0, name).when(k % 5 == 1, F.concat(name, F.lit("\u0430"))).when(k % 5 == 2, "\u043f\u043e\u0447\u0442\u0430").when(k % 5 == 3, k.cast("string")).otherwise(F.concat(name, F.lit("\u0430\u03b1")))
    return src.table(spark, sf_dir, "nation").select("n_nationkey", scripts(label).alias("n"))
