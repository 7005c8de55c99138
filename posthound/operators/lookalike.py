"""Look-alike domains: skeletons, edit distance with swaps, affixes, other endings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posthound.functions.urls import once, registrable
from posthound.plans.registry import Registry

R = Registry()
#: Characters that pass for Latin letters or for each other, and what they pass for (fixed values, one to one).
CONFUSABLE = ("0135$аеорсухіј", "olses" + "aeopcyxij")
AFFIXES = ("secure", "login", "support", "billing", "account", "mail", "online", "help")


def skeleton(name: Column) -> Column:
    """What a name looks like: confusable characters and letter pairs folded."""
    name = F.translate(F.lower(name), *CONFUSABLE)
    for pair, one in (("rn", "m"), ("vv", "w"), ("cl", "d")):
        name = F.replace(name, F.lit(pair), F.lit(one))
    return name


def osa_distance(a: Column, b: Column, limit: int = 3) -> Column:
    """Optimal string alignment distance (insert, delete, replace, swap neighbours) up to `limit`; beyond it limit + 1.

    A dynamic programme over arrays: two rows are carried, since a swap looks back by two.
    """
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")

    def distance(v: Column) -> Column:
        x, y, m, n = v["x"], v["y"], v["m"], v["n"]
        start = F.sequence(F.lit(0), n)

        def row(acc: Column, i: Column) -> Column:
            prev, prev2 = acc["one"], acc["two"]
            cx = F.element_at(x, i)

            def cell(r: Column, j: Column) -> Column:
                cy = F.element_at(y, j)
                cost = F.when(cx == cy, 0).otherwise(1)
                best = F.least(F.element_at(r, -1) + 1, F.element_at(prev, j + 1) + 1, F.element_at(prev, j) + cost)
                swap = (i > 1) & (j > 1) & (cx == F.get(y, j - 2)) & (F.get(x, i - 2) == cy)
                return F.concat(r, F.array(F.when(swap, F.least(best, F.get(prev2, j - 2) + 1)).otherwise(best)))

            new = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.array(i), cell)).otherwise(F.array(i))
            return F.struct(new.alias("one"), prev.alias("two"))

        full = F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.struct(start.alias("one"), start.alias("two")), row, lambda acc: F.element_at(acc["one"], -1))
        return F.least(F.when(m == 0, n).otherwise(full), F.lit(limit + 1))

    # One swap is two plain edits, so a plain distance beyond twice the limit settles it cheaply. Characters are cut once, not once a cell.
    cut = F.struct(chars(a).alias("x"), chars(b).alias("y"), F.length(a).alias("m"), F.length(b).alias("n"))
    return F.when(F.levenshtein(a, b) > 2 * limit, F.lit(limit + 1)).otherwise(once(cut, distance))


def lookalike_kind(host: Column, targets: tuple[str, ...]) -> Column:
    """How a host imitates one of a few target domains: tld_swap, homoglyph, typo, affix or subdomain; null if it does not, or is one.

    For many targets, and for names of xn--, take deception.imitations(), which joins.
    """
    out = F.lit(None).cast("string")
    domain = registrable(host)
    name = F.substring_index(domain, ".", 1)
    for t in reversed(targets):
        own = t.split(".")[0]
        reach = 0 if len(own) <= 3 else 1 if len(own) <= 6 else 2
        affix = F.lit(False)
        for word in AFFIXES:
            affix = affix | name.isin(f"{own}-{word}", f"{word}-{own}", f"{own}{word}", f"{word}{own}")
        kind = (
            F.when(name == own, "tld_swap")
            .when(skeleton(name) == skeleton(F.lit(own)), "homoglyph")
            .when((osa_distance(name, F.lit(own), reach) <= reach) if reach else F.lit(False), "typo")
            .when(affix, "affix")
            .when(F.concat(F.lit("."), host).contains(f".{t}."), "subdomain")
        )
        out = F.when((domain == t) | host.endswith("." + t), F.lit(None)).otherwise(F.coalesce(kind, out))
    return out


_FOLD = "lower(regexp_replace(n_name, '[^A-Za-z]', '', 'g'))"


@R.add(
    f"""WITH n AS (SELECT {_FOLD} AS a, n_nationkey AS k FROM nation),
f AS (SELECT a, k, unnest([substr(a, 2, 1) || substr(a, 1, 1) || substr(a, 3), substr(a, 2), a || 'x', 'q' || substr(a, 2), a, 'zz' || substr(a, 3) || 'zz', '']) AS b, unnest(range(7)) AS f FROM n)
SELECT a, b, CAST(CASE f WHEN 0 THEN CASE WHEN substr(a, 1, 1) = substr(a, 2, 1) THEN 0 ELSE 1 END WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 0 WHEN 5 THEN 4 ELSE least(4, length(a)) END AS INTEGER) AS distance FROM f"""
)
def lookalike_osa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's name against itself, with its first letters swapped, one taken away, added or replaced, four changed, and against nothing."""
    from posthound.sources import adapters as src

    a = F.col("a")
    rows = src.table(spark, sf_dir, "nation").select(F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "")).alias("a"))
    rest = a.substr(3, 99)
    forms = F.array(F.concat(a.substr(2, 1), a.substr(1, 1), rest), a.substr(2, 99), F.concat(a, F.lit("x")), F.concat(F.lit("q"), a.substr(2, 99)), a, F.concat(F.lit("zz"), rest, F.lit("zz")), F.lit(""))
    return rows.withColumn("b", F.explode(forms)).select("a", "b", osa_distance(F.col("a"), F.col("b")).alias("distance"))


#: Hosts around corp.example with a number in them, and what they are.
_AROUND = (("corp.example", ""), ("m{}.corp.example", ""), ("corp.net", "tld_swap"), ("www{}.c0rp.example", "homoglyph"), ("w.{}.crop.example", "typo"), ("corp-login.example", "affix"), ("corp.example.evil{}.net", "subdomain"), ("other{}.example", ""))


@R.add("SELECT page_id, replace(h, '{}', CAST(page_id AS VARCHAR)) AS host, kind FROM pages JOIN (VALUES " + ", ".join(f"({i}, '{h}', '{k}')" for i, (h, k) in enumerate(_AROUND)) + ") t(f, h, kind) ON page_id % 8 = f")
def brand_affix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host for every page: of the company, like it, or neither."""
    from posthound.sources import adapters as src

    form = F.get(F.array(*[F.lit(h) for h, _ in _AROUND]), (F.col("page_id") % 8).cast("int"))
    rows = src.table(spark, sf_dir, "pages").select("page_id", F.replace(form, F.lit("{}"), F.col("page_id").cast("string")).alias("host"))
    return rows.select("page_id", "host", F.coalesce(lookalike_kind(F.col("host"), ("corp.example",)), F.lit("")).alias("kind"))


@R.add("SELECT DISTINCT c_name, translate(lower(c_name), '0135$', 'olses') AS folded FROM (SELECT 'Customer ' || CAST(c_custkey AS VARCHAR) AS c_name FROM customer)")
def skeleton_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons over invented names; the letter pairs do not occur in them."""
    from posthound.sources import adapters as src

    rows = src.table(spark, sf_dir, "customer").select(F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")).alias("c_name")).distinct()
    return rows.select("c_name", skeleton(F.col("c_name")).alias("folded"))
