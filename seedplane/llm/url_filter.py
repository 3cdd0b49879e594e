"""URL filter: rules first, then a path-template tree per host (DataFrame functions only).

Each host's paths form a tree of segments. Digit runs and overlong segments are generalised at once; a
literal child that few urls support, in number and as a share of its parent's, becomes the wildcard ``*``. Sibling templates whose
labelled block rates do not differ significantly from their siblings' pooled rate are merged into one
branch. A branch is rejected when its smoothed labelled purity (share of block labels) reaches a threshold.

Labels are a nullable boolean column (true: block); the query takes them from the rules' own verdicts.
All tree work runs on distinct (host, path shape) rows with counts, so a host with a third of the urls is
pre-aggregated before it is shuffled; the verdicts return to the pages by one plain equi-join, whose large
partitions adaptive execution splits.

Edge cases: a null url or one without ``://`` has an empty host and path, no rule, and verdict ``allow``;
repeated rows each get their own verdict; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, dropped, written

MAX_RULES = 1000
#: Levels of the SQL twin; the operator's tree is as deep as the paths.
LEVELS = 3
MIN_SHARE = 0.05
#: Urls that keep a literal its own branch on a parent of any size.
SUPPORT = 20
LONG_SEGMENT = 32
STRENGTH = 4.0
PRIOR = 0.1
THRESHOLD = 0.5
Z = 1.96


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def rule_of(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, blocks) of the longest rule that fits; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    text, blocks = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        text = F.when(_fits(rule, host, path), F.lit(rule.text)).otherwise(text)
        blocks = F.when(_fits(rule, host, path), F.lit(rule.block)).otherwise(blocks)
    return text, blocks


def shape_of(path: Column) -> Column:
    """All segments, with digit runs as ``#`` and overlong ones as ``*``."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(F.length(s) > LONG_SEGMENT, F.lit("*")).otherwise(F.regexp_replace(s, "[0-9]+", "#")))


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, n, blocks, labelled, template): per level, thin children become wildcards.

    A level is split only where several shapes are left; a shape that is alone in its branch is named to its end at once.
    """
    live, ended, level = written(shapes.withColumn("template", F.lit("")), "url-shapes"), [], 0
    deepest = live.agg(F.max(F.size("shape"))).first()[0] or 0
    while level < deepest:
        level += 1
        segment = F.when(F.size("shape") >= level, F.element_at("shape", level)).otherwise(F.lit(""))
        leveled = live.withColumn("segment", segment)
        child = leveled.groupBy("host", "template", "segment").agg(F.sum("n").alias("child_n"))
        parent = child.groupBy("host", "template").agg(F.sum("child_n").alias("parent_n"))
        enough = F.least(MIN_SHARE * F.col("parent_n"), F.lit(float(SUPPORT)))
        kept = child.join(parent, ["host", "template"]).withColumn("keeps", (F.col("child_n") >= 2) & (F.col("child_n") >= enough)).select("host", "template", "segment", "keeps")
        tree = leveled.join(kept, ["host", "template", "segment"]).withColumn(
            "template", F.when(F.col("segment") == "", F.col("template")).otherwise(F.concat("template", F.lit("/"), F.when(F.col("keeps"), F.col("segment")).otherwise(F.lit("*"))))
        ).drop("segment", "keeps")
        left = tree.filter(F.size("shape") >= level).groupBy("host", "template").agg(F.count("*").alias("kinds"))
        rest = F.transform(F.slice("shape", level + 1, F.greatest(F.lit(0), F.size("shape") - level)), lambda s: F.concat(F.lit("/"), F.when(F.col("n") >= 2, s).otherwise(F.lit("*"))))
        goes_on = (F.size("shape") >= level) & (F.col("kinds") > 1)
        tree = tree.join(left, ["host", "template"], "left").withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
        tree = tree.withColumn("template", F.when(F.col("goes_on"), F.col("template")).otherwise(F.concat("template", F.array_join(rest, "")))).drop("kinds")
        tree = written(tree, "url-tree")
        dropped(live)
        ended.append(tree.filter("not goes_on").drop("goes_on"))
        live = tree.filter("goes_on").drop("goes_on")
        deepest = live.agg(F.max(F.size("shape"))).first()[0] or 0
    for part in ended:
        live = live.unionByName(part)
    return live


def rejected(tree: DataFrame) -> DataFrame:
    """(host, template, rejected): similar siblings merge, then the smoothed purity decides."""
    leaf = tree.groupBy("host", "template").agg(F.sum("blocks").alias("blocks"), F.sum("labelled").alias("labelled")).withColumn("parent", F.regexp_replace("template", "/[^/]*$", ""))
    pooled = leaf.groupBy("host", "parent").agg(F.sum("blocks").alias("all_blocks"), F.sum("labelled").alias("all_labelled"))
    p = F.try_divide(F.col("all_blocks"), F.col("all_labelled"))
    far = F.abs(F.col("blocks") - F.col("labelled") * p) > Z * F.sqrt(F.col("labelled") * p * (1 - p))
    leaf = leaf.join(pooled, ["host", "parent"]).withColumn("branch", F.when((F.col("labelled") > 0) & ~F.coalesce(far, F.lit(False)), F.lit("~")).otherwise(F.col("template")))
    branch = leaf.groupBy("host", "parent", "branch").agg(F.sum("blocks").alias("b"), F.sum("labelled").alias("l"))
    purity = (F.col("b") + STRENGTH * PRIOR) / (F.col("l") + STRENGTH)
    return leaf.select("host", "parent", "branch", "template").join(branch, ["host", "parent", "branch"]).select("host", "template", (purity >= THRESHOLD).alias("rejected"))


def url_filter(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row; see the module's text for the method and edge cases."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    text, blocks = rule_of(rules, F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", text.alias("rule"), blocks.alias("rule_blocks"), shape_of(F.col("path")).alias("shape"))
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if(F.col("rule_blocks")).alias("blocks"), F.count("rule_blocks").alias("labelled"))
    tree = templates(shapes)
    verdicts = tree.select("host", "shape", "template").join(rejected(tree), ["host", "template"]).select("host", "shape", "rejected")
    blocked = F.coalesce(F.col("rule_blocks"), F.col("rejected") & (F.col("host") != ""), F.lit(False))
    return rows.join(verdicts, ["host", "shape"], "left").select("page_id", "host", "path", "rule", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


#: The rules of the contract.
CONTRACT_RULES = [
    Rule("com", "/en/", True),
    Rule("example.com", "/en/7", False),
    Rule("net", "/de/", False),
    Rule("example.net", "/de/8", True),
    Rule("org", "/es/", True),
]


def oracle(rules: list[Rule] = CONTRACT_RULES) -> str:
    """The same verdicts as one DuckDB statement."""
    fit = lambda r: f"((host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}'))"
    by_length = sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text), reverse=True)
    rule = "case " + " ".join(f"when {fit(r)} then '{r.text}'" for r in by_length) + " end"
    block = "case " + " ".join(f"when {fit(r)} then {'true' if r.block else 'false'}" for r in by_length) + " end"
    levels = ""
    for i in range(1, LEVELS + 1):
        levels += f"""
s{i} as (select host, shape, n, blocks, labelled, template, case when len(shape) >= {i} then shape[{i}] else '' end as segment from t{i - 1}),
c{i} as (select host, template, segment, sum(n) as child_n from s{i} group by host, template, segment),
p{i} as (select host, template, sum(child_n) as parent_n from c{i} group by host, template),
k{i} as (select c{i}.host, c{i}.template, c{i}.segment, child_n >= 2 and child_n >= {MIN_SHARE} * parent_n as keeps from c{i} join p{i} on c{i}.host = p{i}.host and c{i}.template = p{i}.template),
t{i} as (select s{i}.host, s{i}.shape, s{i}.n, s{i}.blocks, s{i}.labelled,
  case when s{i}.segment = '' then s{i}.template else s{i}.template || '/' || case when keeps then s{i}.segment else '*' end end as template
  from s{i} join k{i} on s{i}.host = k{i}.host and s{i}.template = k{i}.template and s{i}.segment = k{i}.segment),"""
    last = f"t{LEVELS}"
    return f"""
with parts as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
hosts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{UPPER.lower()}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
segs as (select page_id, host, path, {rule} as rule, {block} as rule_blocks,
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: case when length(x) > {LONG_SEGMENT} then '*' else regexp_replace(x, '[0-9]+', '#', 'g') end) as shaped from hosts),
rowz as (select page_id, host, path, rule, rule_blocks, case when len(shaped) > {LEVELS} then list_concat(shaped[1:{LEVELS}], ['**']) else shaped end as shape from segs),
t0 as (select host, shape, count(*) as n, sum(case when rule_blocks then 1 else 0 end) as blocks, count(rule_blocks) as labelled, '' as template from rowz group by host, shape),{levels}
leaf as (select host, template, sum(blocks) as blocks, sum(labelled) as labelled, regexp_replace(template, '/[^/]*$', '') as parent from {last} group by host, template),
pooled as (select host, parent, sum(blocks) as all_blocks, sum(labelled) as all_labelled from leaf group by host, parent),
merged as (select leaf.host, leaf.parent, leaf.template, leaf.blocks, leaf.labelled,
  case when leaf.labelled > 0 and abs(leaf.blocks - leaf.labelled * (all_blocks / nullif(all_labelled, 0))) <= {Z} * sqrt(leaf.labelled * (all_blocks / nullif(all_labelled, 0)) * (1 - all_blocks / nullif(all_labelled, 0))) then '~' else leaf.template end as branch
  from leaf join pooled on leaf.host = pooled.host and leaf.parent = pooled.parent),
branches as (select host, parent, branch, (sum(blocks) + {STRENGTH * PRIOR}) / (sum(labelled) + {STRENGTH}) >= {THRESHOLD} as rejected from merged group by host, parent, branch),
verdicts as (select {last}.host, {last}.shape, rejected from {last}
  join merged on {last}.host = merged.host and {last}.template = merged.template
  join branches on merged.host = branches.host and merged.parent = branches.parent and merged.branch = branches.branch)
select rowz.page_id, rowz.host, rowz.path, rowz.rule,
  case when coalesce(rowz.rule_blocks, verdicts.rejected and rowz.host <> '', false) then 'block' else 'allow' end as verdict
from rowz left join verdicts on rowz.host = verdicts.host and rowz.shape = verdicts.shape
"""
