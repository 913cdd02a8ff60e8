"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes (1: bad) come from the content of pages alone and are counted by host, registered domain and
suffix. Beta-binomial priors shrink each level towards the one above it: suffix to all pages, registered domain to its
suffix, host to its registered domain. The strength of each level's prior is a moment estimate pooled over that level.
A host is blocked if its share of bad pages is over LIMIT with a posterior probability of SURE or more, which is to say
that the 1 - SURE quantile of its beta posterior is over LIMIT.

Everything is counts by key, aggregated before the shuffle. Only blocked hosts are joined back to the pages, by broadcast
if a count shows that they are few.

Defined cases: a url that is null or has no ``://`` has an empty host and path, which form one host like any other;
suffix: last label, or two if the last is a country's (two letters) and the one before is in SECOND_LEVEL; registered
domain: one label more (a host of fewer labels, or of digits and dots, is its own); pages without a label still get a
verdict; repeated rows count each; no pages give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

#: (rule's host, rule's path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Labels under which countries register names (co.uk, com.au, ...).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "govt", "gv", "go", "id", "in", "info", "ltd", "me", "mil", "mod", "ne", "net", "nom", "nhs", "or", "org", "plc", "sch", "school", "web")
#: A page is bad if its markup holds runs of symbols or exclamation marks.
BAD_MARKS = r"###|\$\$\$|%%%|\*\*\*|(?:&amp;){3}|!!"
LIMIT, SURE, LEAST_STRENGTH, MOST_STRENGTH = 0.1, 0.9, 2.0, 1000.0
#: Steps of the continued fraction of the beta distribution; Stirling's series begins at this shift.
STEPS, SHIFT = 200, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(after, "^[^/?#]*", 0), F.lit(""))
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path as one string) and its verdict; null if none fits."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    last_two = F.substring_index(host, ".", -2)
    two = F.rlike(host, F.lit(rf"(?:^|\.)(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$"))
    own = ~F.contains(host, F.lit(".")) | F.rlike(host, F.lit(r"^[0-9.:]*$"))
    suffix = F.when(own, host).when(two, last_two).otherwise(F.substring_index(host, ".", -1))
    return suffix, F.when(own, host).when(two, F.substring_index(host, ".", -3)).otherwise(last_two)


def outcome(html: Column) -> Column:
    """1 (bad), 0 (good) or null (a page without text has no label)."""
    return F.when(html.isNotNull(), F.rlike(html, F.lit(BAD_MARKS)).cast("int"))


def _log_gamma_sql(z: str, ln: str = "ln") -> str:
    """Stirling's series of ln gamma(z + SHIFT), less the logarithms of the factors between."""
    y = f"({z} + {SHIFT})"
    between = " * ".join(f"({z} + {i})" for i in range(SHIFT))
    return f"(({y} - 0.5D) * {ln}({y}) - {y} + 0.9189385332046727D + 1 / (12 * {y}) - 1 / (360 * {y} * {y} * {y}) + 1 / (1260 * pow({y}, 5)) - {ln}({between}))"


def _beta_cdf(x: float, a: str, b: str) -> Column:
    """The share of the beta distribution (a, b) up to x, by the continued fraction on the side where it converges."""

    def side(x: float, a: str, b: str) -> str:
        front = f"exp({_log_gamma_sql(f'({a} + {b})')} - {_log_gamma_sql(a)} - {_log_gamma_sql(b)} + {a} * ln({x}D) + {b} * ln(1 - {x}D)) / {a}"
        odd = f"-(({a} + h) * ({a} + {b} + h) * {x}D) / (({a} + 2 * h) * ({a} + 2 * h + 1))"
        even = f"(h * ({b} - h) * {x}D) / (({a} + 2 * h - 1) * ({a} + 2 * h))"
        # Step m of the fraction, from the last to the first: h = m div 2.
        term = f"transform(array(double(m div 2)), h -> 1 + (CASE WHEN m % 2 = 1 THEN {odd} ELSE {even} END) / f)[0]"
        return f"({front}) / aggregate(sequence({STEPS}, 1, -1), 1D, (f, m) -> {term})"

    return F.expr(f"CASE WHEN {x}D < ({a} + 1) / ({a} + {b} + 2) THEN {side(x, a, b)} ELSE 1 - {side(1 - x, b, a)} END")


def _strength(children: DataFrame, parent: list[str]) -> Column:
    """The pooled moment estimate of a level's prior strength from children (y bad of n) by parent, as a scalar."""
    rate = F.col("y") / F.col("n")
    top = children.groupBy(*parent).agg(F.sum("y").alias("Y"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("N2"), F.count("*").alias("k"), F.sum(F.col("n") * rate * rate).alias("S2"))
    m = F.col("Y") / F.col("N")
    between = F.col("S2") - F.col("N") * m * m - m * (1 - m) * (F.col("k") - 1)
    within = m * (1 - m) * (F.col("N") - F.col("N2") / F.col("N") - (F.col("k") - 1))
    rho = F.sum(between) / F.sum(within)
    strength = F.when((F.sum(within) > 0) & (rho > 0) & (rho < 1), (1 - rho) / rho).when((F.sum(within) > 0) & (rho >= 1), F.lit(LEAST_STRENGTH)).otherwise(F.lit(MOST_STRENGTH))
    return top.agg(F.least(F.greatest(strength, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)).alias("k")).scalar()


def host_reputation(labelled: DataFrame) -> DataFrame:
    """(host, bad) rows, bad null where unlabelled, to a row per host: the posterior mean of its share of bad pages,
    and the probability that this share is over LIMIT."""
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = labelled.groupBy("host").agg(F.sum("bad").alias("y"), F.count("bad").alias("n")).select("host", suffix.alias("suffix"), domain.alias("domain"), F.coalesce("y", F.lit(0)).alias("y"), "n")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    k1, k2, k3 = _strength(suffixes.where("n > 0"), []), _strength(domains.where("n > 0"), ["suffix"]), _strength(hosts.where("n > 0"), ["suffix", "domain"])
    m0 = suffixes.agg(((F.sum("y") + 1) / (F.sum("n") + 2)).alias("m")).scalar()
    s = suffixes.select("suffix", ((F.col("y") + k1 * m0) / (F.col("n") + k1)).alias("ms"))
    d = domains.join(s, "suffix").select("suffix", "domain", ((F.col("y") + k2 * F.col("ms")) / (F.col("n") + k2)).alias("md"))
    h = hosts.join(d, ["suffix", "domain"]).select("host", (F.col("y") + k3 * F.col("md")).alias("a"), (F.col("n") + k3).alias("t"))
    posterior = h.select("host", (F.col("a") / F.col("t")).alias("bad_mean"), F.col("a"), (F.col("t") - F.col("a")).alias("b"))
    return posterior.select("host", "bad_mean", (1 - _beta_cdf(LIMIT, "a", "b")).alias("bad_sure"))


def judge_urls(pages: DataFrame) -> DataFrame:
    """page_id, url and html to page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col("url"))
    reputation = host_reputation(pages.select(host.alias("host"), outcome(F.col("html")).alias("bad")))
    blocked = small(cut(reputation.where(F.col("bad_sure") >= SURE).select("host", F.lit("block").alias("own")), "url-blocked"))
    rule, verdict = rule_for(F.col("host"), F.col("path"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).join(blocked, "host", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("own"), F.lit("allow")).alias("verdict"))


def _host_sql() -> str:
    return "case when instr(url, '://') > 0 then translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), '" + UPPER + "', '" + LOWER + "') else '' end"


def _strength_sql(name: str, children: str, parent: str) -> str:
    return f"""{name} as (select least(greatest(case when sum(w) > 0 and sum(b) / sum(w) > 0 and sum(b) / sum(w) < 1 then (1 - sum(b) / sum(w)) / (sum(b) / sum(w))
      when sum(w) > 0 and sum(b) / sum(w) >= 1 then {LEAST_STRENGTH} else {MOST_STRENGTH} end, {LEAST_STRENGTH}), {MOST_STRENGTH}) as k
      from (select s2 - tn * m * m - m * (1 - m) * (k - 1) as b, m * (1 - m) * (tn - n2 / tn - (k - 1)) as w from
      (select sum(y) / sum(n) as m, sum(n) as tn, sum(n * n) as n2, count(*) as k, sum(n * (y / n) * (y / n)) as s2 from {children} where n > 0 {parent})))"""


def _cdf_sql(x: float, a: str, b: str) -> str:
    front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) / {a}"
    odd = f"-(({a} + m // 2) * ({a} + {b} + m // 2) * {x}) / (({a} + 2 * (m // 2)) * ({a} + 2 * (m // 2) + 1))"
    even = f"((m // 2) * ({b} - m // 2) * {x}) / (({a} + 2 * (m // 2) - 1) * ({a} + 2 * (m // 2)))"
    terms = f"list_transform(range({STEPS}, 0, -1), lambda m: (case when m % 2 = 1 then {odd} else {even} end)::double)"
    return f"({front}) / list_reduce(list_concat([1.0::double], {terms}), lambda f, d: 1 + d / f)"


def judge_sql(rules=RULES) -> str:
    """The same in DuckDB SQL."""
    fits = [(h + p, v, f"(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')") for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))]
    rule = "case " + " ".join(f"when {f} then '{r}'" for r, _, f in fits) + " end"
    verdict = "case " + " ".join(f"when {f} then '{v}'" for _, v, f in fits) + f" when bad_sure >= {SURE} then 'block' else 'allow' end"
    label = "string_split(host, '.')"
    last = lambda n: f"array_to_string(list_slice({label}, greatest(1, len({label}) - {n - 1}), len({label})), '.')"
    own = "(not contains(host, '.') or regexp_full_match(host, '[0-9.:]*'))"
    two = f"regexp_full_match({last(2)}, '(?:{'|'.join(SECOND_LEVEL)})\\.[a-z][a-z]')"
    return f"""with a as (select page_id, url, html, {_host_sql()} as host, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    p as (select page_id, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') as path, case when html is not null then regexp_matches(html, '{BAD_MARKS}')::int end as bad from a),
    h as (select host, coalesce(sum(bad), 0)::double as y, count(bad)::double as n,
      case when {own} then host when {two} then {last(2)} else {last(1)} end as suffix,
      case when {own} then host when {two} then {last(3)} else {last(2)} end as domain from p group by host),
    d as (select suffix, domain, sum(y) as y, sum(n) as n from h group by all), s as (select suffix, sum(y) as y, sum(n) as n from d group by all),
    {_strength_sql("k1", "s", "")}, {_strength_sql("k2", "d", "group by suffix")}, {_strength_sql("k3", "h", "group by suffix, domain")},
    m0 as (select (sum(y) + 1) / (sum(n) + 2) as m from s),
    ms as (select suffix, (y + k1.k * m0.m) / (n + k1.k) as ms from s, k1, m0),
    md as (select d.suffix, domain, (y + k2.k * ms) / (n + k2.k) as md from d join ms using (suffix), k2),
    r as (select host, y + k3.k * md as a, n + k3.k - y - k3.k * md as b from h join md using (suffix, domain), k3),
    b as (select host, 1 - case when {LIMIT} < (a + 1) / (a + b + 2) then {_cdf_sql(LIMIT, "a", "b")} else 1 - {_cdf_sql(1 - LIMIT, "b", "a")} end as bad_sure from r)
    select page_id, host, path, {rule} as rule, {verdict} as verdict from p left join b using (host)"""
