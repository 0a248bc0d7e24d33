"""Text evidence of announcements: title classes, the gate of plans, fields of plans, evidence of repurchases.

White space carries no meaning in these texts (it comes from page layout), so all functions drop it first.
"""

from __future__ import annotations

import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide a title's class, in the order in which they are tried.
LOCKUP = r"(限售|锁定|解禁|禁售|持有)[^，。；]{0,8}?(期满|届满|到期)"
ASSET_PLAN = r"(资管|资产管理|纾困|信托|理财)[^，。；]{0,16}?计划到期"
INTENDED = r"(拟|预计)[^，。；]{0,4}减持"
REVISION = r"更正|修订|补充|减持[^，。；]{0,12}修正|修正[^，。；]{0,4}减持|减持(股份)?计划[^，。；]{0,4}(变更|调整|延期)|(变更|调整|延期)[^，。；]{0,2}减持(股份)?计划"
TERMINATION = r"减持(股份)?计划[^，。；]{0,8}(提前)?(终止|结束)|(提前)?(终止|结束)[^，。；]{0,8}减持|提前终止"
HALFWAY = r"(时间|数量)过半"
PROGRESS = r"进展|实施情况"
RESULT = r"减持(股份)?结果|减持[^，。；]{0,12}计划[^，。；]{0,8}(期满|届满|到期)|期满未减持|减持(股份)?(计划)?[^，。；]{0,4}完毕|减持完成"
REACHED = r"减持[^，。；]{0,12}(达到|累计超过|累计达到|(?<!不)超过)[^，。；]{0,8}[0-9０-９.．]+\s*[%％]"
PREDISCLOSED = r"预披露|(新|后续|未来)[^，。；]{0,12}减持"
NEW_PLAN = r"(暨|及)[^，。；]{0,16}预披露|(后续|未来|新)[^，。；]{0,12}减持[^，。；]{0,10}预披露"
SUSPECT = r"过半|进展|期满|届满|到期|结果|完毕|完成|终止|结束|更正|修订|补充|变更|调整|延期|实施"

# The gate of plans that are announced before they begin.
GATE_NEEDS, GATE_KINDS = "减持", "计划|预披露"
GATE_EXCLUDES = "期限届满|实施|进展|减持结果|完成|届满|增持|不减持|回购|要约"

# Holder, ratio and period of a plan.
DAY = r"[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日"
PERIODS = (rf"减持期间[：:]({DAY})[-—~至]+({DAY})", rf"计划在({DAY})[-—~至]+({DAY})")
RELATIVE = r"(本(?:次)?(?:减持计划)?公告(?:披露)?之日起[^，。；]{0,50}?(?:个月内|日内|之内))"
ENTITY = r"(?:股份有限公司|有限责任公司|有限公司|合伙企业|投资中心|管理中心|资产管理|基金|集团|银行|证券|保险|信托)"
HOLDERS = (
    r"股东的?名称[：:]([^，。；、（(]{2,40})",
    rf"(?:持股[^，。；、]{{0,10}}?股东|公司股东|控股股东|第[一二三四五六]大股东|、股东|的股东|^股东|。股东)([一-龥]{{2,26}}?{ENTITY})(?:（[^）]{{0,25}}）)?(?:计划|拟|将|，|、|（以下)",
    r"(?:高级管理人员|监事|董事|控股股东|一致行动人)[^，。；]{0,10}?([一-龥]{2,4})(?:先生|女士)",
)
NOT_A_HOLDER = "减持|预披露|公告|计划|情况|披露|本公司|证券交易所"
ROLES = "^(?:独立董事|董事会秘书|副总经理|财务总监|高级管理人员|总经理|副总裁|董事|监事|董秘|及其一致行动人|一致行动人|之一)+"
EDGES = r"^[的。、，（(“\" ]+|[的。、，（(“\" ]+$"
RATIOS = (r"不超过[^%]{0,110}?总股本[^%]{0,20}?([0-9.]+)%", r"减持[^%]{0,60}?不超过[^%]{0,60}?([0-9.]+)%")

# Repurchases.
REPURCHASE_EXCLUDES = "进展|实施|完成|结果|期限届满|股份变动|修订|调整|法律意见|独立意见|核查意见|债权人|董事会决议|监事会决议"
BOARD_FIRST = r"董事会.{0,180}(?:审议通过|通过).{0,180}回购.{0,100}(?:方案|议案)|回购.{0,100}(?:方案|议案).{0,180}(?:经|由).{0,100}董事会.{0,80}(?:审议通过|通过)"
SCHEME_REVISED = r"(?:回购方案|回购股份方案)(?:修订稿|修订版|调整稿|变更稿)|(?:修订后|调整后|变更后)(?:的)?(?:回购方案|回购股份方案)"
PRICE_LIMIT = r"回购(?:股份)?(?:的)?价格.{0,60}?(?:不超过|不高于|上限为|最高为|为)(?:人民币)?([0-9]+(?:\.[0-9]+)?)元/?股"
CANCELLATION = r"用于.{0,30}注销.{0,40}减少.{0,20}注册资本|回购.{0,30}股份.{0,30}(?:全部|将).{0,20}注销|(?:本次|上述|同意将|需|公司将).{0,20}回购注销.{0,100}限制性股票|限制性股票.{0,100}(?:全部|由公司|进行|予以|需).{0,30}回购注销|办理.{0,30}减少注册资本.{0,30}(?:股份)?注销"
INVENTORY = r"用于.{0,50}(?:员工持股计划|股权激励)|用于.{0,60}转换.{0,60}可转换.{0,20}公司债券|存放于.{0,40}回购专用证券账户|作为.{0,30}库存股"
OTHER_PURPOSE = r"用于.{0,60}维护公司价值及股东权益|为维护.{0,60}公司价值及股东权益"

# Amounts of goodwill impairment.
AMOUNT = r"([0-9]+(?:\.[0-9]+)?)(亿元|万元|元)"
IMPAIRED = r"(?:计提|确认|预计计提|拟计提)?(?:的)?商誉减值(?:准备|损失)?(?:金额)?"
AMOUNT_RANGE, AMOUNT_EXACT = rf"{IMPAIRED}(?:约|预计)?(?:为|在)?{AMOUNT}(?:至|到|—|－|-){AMOUNT}", rf"{IMPAIRED}(?:约|预计)?(?:为|达|合计为|人民币)?{AMOUNT}"
COMBINED = ("无形资产", "固定资产", "长期股权投资", "资产组", "其他资产", "资产减值")
UNITS = {"元": 1, "万元": 10_000, "亿元": 100_000_000}


def compact(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def reduction_title(title: Column) -> Column:
    """The class of a title about a shareholder's sales; what isn't caught by any class is a first announcement."""
    t = F.regexp_replace(F.regexp_replace(compact(title), LOCKUP, "◇"), ASSET_PLAN, "◇")
    core = F.lit(False)
    for p in (TERMINATION, HALFWAY, PROGRESS, RESULT):
        core = core | t.rlike(p)
    reached = F.regexp_replace(t, INTENDED, "◇").rlike(REACHED)
    return (
        F.when(t.rlike(REVISION), "revision").when(core & t.rlike(NEW_PLAN), "combo_ambiguous").when(t.rlike(TERMINATION), "termination").when(t.rlike(HALFWAY), "halfway")
        .when(t.rlike(PROGRESS), "progress").when(t.rlike(RESULT), "result").when(reached & t.rlike(PREDISCLOSED), "first_with_progress").when(reached, "progress_reached")
        .when(t.rlike(SUSPECT), "suspect_unresolved").otherwise("first_candidate")
    )


def plan_title(title: Column) -> Column:
    """P14: 'pass', or why a title isn't that of a plan announced in advance."""
    t = F.coalesce(title, F.lit(""))
    word = F.regexp_extract(t, GATE_EXCLUDES, 0)
    return F.when(~t.contains(GATE_NEEDS), "no_reduction").when(~t.rlike(GATE_KINDS), "no_plan").when(word != "", F.concat(F.lit("excluded:"), word)).otherwise("pass")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def plan_holder(text: Column) -> Column:
    """The holder by label, as a firm, or as a person; the first that is a clean name."""
    t = compact(text)
    clean = lambda n: F.regexp_replace(F.regexp_replace(F.regexp_replace(n, EDGES, ""), ROLES, ""), "^[的、 ]+|[的、 ]+$", "")
    names = F.transform(F.array(*(F.regexp_extract(t, p, 1) for p in HOLDERS)), clean)
    return F.get(F.filter(names, lambda n: F.length(n).between(2, 40) & ~n.rlike(NOT_A_HOLDER)), F.lit(0))


def plan_ratio(text: Column) -> Column:
    """The largest share of capital that a plan names, in percent; a holder's present share isn't one."""
    t = compact(text)
    return F.coalesce(*(_found(t, p) for p in RATIOS)).try_cast("double")


def _day(text: Column) -> Column:
    part = lambda i: F.lpad(F.regexp_extract(text, r"([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", i), 4 if i == 1 else 2, "0")
    return F.when(text.isNotNull(), F.concat_ws("-", part(1), part(2), part(3)))


def plan_period(text: Column) -> Column:
    """struct(start, end, text, kind): two days, or the words that count from the announcement."""
    t = compact(text)
    lo, hi = (_day(F.coalesce(*(_found(t, p, i) for p in PERIODS))) for i in (1, 2))
    rel = _found(t, RELATIVE)
    kind = F.when(lo.isNotNull(), "absolute").when(rel.isNotNull(), "relative")
    return F.struct(lo.alias("start"), hi.alias("end"), F.when(lo.isNotNull(), F.concat_ws("~", lo, hi)).otherwise(rel).alias("text"), kind.alias("kind"))


def plan_failures(holder: Column, ratio: Column, period: Column) -> Column:
    """The names of the fields that weren't found."""
    return F.array_compact(F.array(F.when(period["kind"].isNull(), "reduce_period"), F.when(holder.isNull(), "holder_name"), F.when(ratio.isNull(), "reduce_ratio_max_pct")))


def repurchase_title(title: Column) -> Column:
    """Whether a title may be that of a repurchase scheme."""
    t = compact(title)
    return t.contains("回购") & ~t.rlike(REPURCHASE_EXCLUDES)


def repurchase_purpose(text: Column) -> Column:
    """What a body says that the shares are for."""
    t = compact(text)
    a, b, c = t.rlike(CANCELLATION), t.rlike(INVENTORY), t.rlike(OTHER_PURPOSE)
    return F.when(a & ~b & ~c, "cancellation").when(b & ~a & ~c, "inventory").when(a | b | c, "other_explicit").otherwise("unclassifiable")


def repurchase_evidence(text: Column, high_limit: Column) -> Column:
    """struct(initial, revised, prices, price_match, supported, purpose) of a body, against the limit that the source states."""
    t = compact(text)
    initial, revised = t.rlike(BOARD_FIRST), t.rlike(SCHEME_REVISED)
    prices = F.transform(F.regexp_extract_all(t, F.lit(PRICE_LIMIT), F.lit(1)), lambda x: x.try_cast("decimal(18,4)"))
    match = F.coalesce(F.array_contains(prices, high_limit.cast("decimal(18,4)")), F.lit(False))
    return F.struct(initial.alias("initial"), revised.alias("revised"), prices.alias("prices"), match.alias("price_match"), (initial & ~revised & match).alias("supported"), repurchase_purpose(text).alias("purpose"))


def goodwill_of(body: str) -> tuple[str, Decimal | None, Decimal | None, int]:
    """(status, low, high, hits) of one text without white space: amounts in yuan, unless their 80 characters around name other assets too."""
    ranges = [(m.span(), m[1], m[2], m[3], m[4]) for m in re.finditer(AMOUNT_RANGE, body)]
    inside = lambda a, b: any(x <= a and b <= y for (x, y), *_ in ranges)
    found = ranges + [(m.span(), m[1], m[2], m[1], m[2]) for m in re.finditer(AMOUNT_EXACT, body) if not inside(*m.span())]
    amounts = []
    for (a, b), lo, lo_unit, hi, hi_unit in found:
        around = body[max(0, a - 80) : b + 80]
        if not any(w in around for w in COMBINED):
            amounts.append((Decimal(lo) * UNITS[lo_unit], Decimal(hi) * UNITS[hi_unit]))
    good = {x for x in amounts if x[0] <= x[1]}
    if len(good) == 1:
        return "qualified", *next(iter(good)), len(found)
    return "not_quantified" if not found else "amount_conflict" if good else "combined_unseparable", None, None, len(found)


def goodwill_evidence(text: Column) -> Column:
    """struct(status, low, high, hits). Where matches lie decides what counts, which Spark's regular expressions don't tell: an Arrow function."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([goodwill_of(t) for t in texts], columns=["status", "low", "high", "hits"])

    return F.pandas_udf(run, "status string, low decimal(24,4), high decimal(24,4), hits int")(compact(text))
