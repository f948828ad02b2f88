"""Ordered groups in text, as ``(2,*5,7)-1,4=3``: members side by side in brackets, gaps between groups.

``,`` ``-`` and ``=`` stand for a gap of 1 to 2, 2 to 5, and 5 or more; without a sign the gap isn't
known. ``*`` marks the leader of its group. What the text doesn't tell stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width characters of the notation and what they stand for.
WIDE = "（）＊，－＝０１２３４５６７８９"
PLAIN = "()*,-=0123456789"

#: Fixed value: what a rank band rests on.
RANK_BASIS = "source_notation_bounds_not_continuous_tracking"

_SET, _ONE = r"\(\*?[0-9]+(?:,\*?[0-9]+)*\)", r"\*?[0-9]+"
_VALID = rf"^(?:{_SET}|{_ONE})(?:[,=-](?:{_SET}|{_ONE})|{_SET}|\*[0-9]+|(?<=\))[0-9]+)*\z"
_TOKEN = r"([,=-]?)(\([^()]*\)|\*?[0-9]+)"


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(text: Column) -> Column:
    """Plain characters for full-width ones, without white space."""
    return F.regexp_replace(F.translate(text, WIDE, PLAIN), r"(?U)\s+", "")


def gap(sign: Column) -> Column:
    """(low, high): low is reached, high is not; both null if not known."""
    low = F.when(sign == ",", 1.0).when(sign == "-", 2.0).when(sign == "=", 5.0)
    high = F.when(sign == ",", 2.0).when(sign == "-", 5.0).when(sign == "=", float("inf"))
    return F.struct(sign.alias("sign"), low.alias("low"), high.alias("high"))


def groups(text: Column) -> Column:
    """Groups of well-formed folded text: members, leader, inner_to_outer, gap (null for the first).

    Brackets tell the order from the inside; a bare number has none.
    """

    def group(token: Column, i: Column) -> Column:
        members = F.regexp_extract_all(token, F.lit(r"[0-9]+"), F.lit(0)).cast("array<int>")
        leader = F.nullif(F.regexp_extract(token, r"\*([0-9]+)", 1), F.lit("")).cast("int")
        sign = F.regexp_extract(token, r"^([,=-]?)", 1)
        return F.struct(
            members.alias("members"),
            leader.alias("leader"),
            F.when(token.contains("("), members).alias("inner_to_outer"),
            F.when(i > 0, gap(F.when(sign == "", "unknown").otherwise(sign))).alias("gap"),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), group)


def flaw(text: Column, roster: Column | None = None) -> Column:
    """What is wrong with a notation: null if nothing, else the first of

    ``missing`` (null), ``empty``, ``grammar``, ``leaders`` (two in a group), ``number`` (under 1
    or too large), ``duplicate``, ``roster`` (members are not exactly those of ``roster``).
    """

    def check(s: Column, members_: Column) -> Column:
        out = (
            F.when(s.isNull(), "missing")
            .when(s == "", "empty")
            .when(~s.rlike(_VALID), "grammar")
            .when(s.rlike(r"\([^)]*\*[^)]*\*"), "leaders")
            .when(F.exists(members_, lambda n: n.isNull() | (n < 1)), "number")
            .when(F.size(F.array_distinct(members_)) < F.size(members_), "duplicate")
        )
        return out if roster is None else out.when(roster.isNotNull() & ~same_set(members_, roster), "roster")

    def numbers(s: Column) -> Column:
        return F.transform(F.regexp_extract_all(s, F.lit(r"[0-9]+"), F.lit(0)), lambda n: n.try_cast("int"))

    return let(fold(text), lambda s: let(numbers(s), lambda ms: check(s, ms)))


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def parse(text: Column, roster: Column | None = None) -> Column:
    """(raw, flaw, groups): groups are null where the notation has a flaw."""
    return let(flaw(text, roster), lambda wrong: F.struct(text.alias("raw"), wrong.alias("flaw"), F.when(wrong.isNull(), groups(fold(text))).alias("groups")))


def members(groups_: Column) -> Column:
    return F.flatten(F.transform(groups_, lambda g: g["members"]))


def _group_of(groups_: Column, runner: Column) -> Column:
    """The index from 0 of the runner's group; null if it isn't observed."""
    at = F.array_position(F.transform(groups_, lambda g: F.array_contains(g["members"], runner)), F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


def _placed(groups_: Column) -> Column:
    """Each observed runner with its group, its place from the inside (null if not told) and whether it leads."""

    def place(g: Column, i: Column) -> Column:
        return F.transform(g["members"], lambda m, p: F.struct(m.alias("runner"), i.alias("group"), F.when(g["inner_to_outer"].isNotNull(), p).alias("place"), F.coalesce(g["leader"] == m, F.lit(False)).alias("leads")))

    return F.flatten(F.transform(groups_, place))


def _related(x: Column, y: Column) -> Column:
    same, led = x["group"] == y["group"], x["leads"] | y["leads"]
    before = F.when(~same, x["group"] < y["group"]).when(led, x["leads"])
    basis = F.when(~same, "ordered_groups").when(led, "marked_leader").otherwise("longitudinal_order_unknown")
    return F.struct(same.alias("same_group"), before.alias("a_before_b"), F.when(same, x["place"] < y["place"]).alias("a_inside_b"), basis.alias("basis"))


def relation(groups_: Column, a: Column, b: Column) -> Column:
    """(same_group, a_before_b, a_inside_b, basis) of two runners; null where one isn't observed or both are one.

    In different groups the order of groups tells; within one, only a leader is known to be ahead,
    and who is inside follows the bracket's order.
    """

    def find(placed: Column, runner: Column) -> Column:
        return F.get(F.filter(placed, lambda x: x["runner"] == runner), F.lit(0))

    return let(_placed(groups_), lambda p: let(find(p, a), lambda x: let(find(p, b), lambda y: F.when(x.isNotNull() & y.isNotNull() & (a != b), _related(x, y)))))


def pairs(groups_: Column) -> Column:
    """(a, b, relation) of each two observed runners, a < b, without a shuffle."""

    def each(ms: Column) -> Column:
        return F.flatten(F.transform(ms, lambda x, i: F.transform(F.slice(ms, i + 2, F.size(ms)), lambda y: F.struct(x["runner"].alias("a"), y["runner"].alias("b"), _related(x, y).alias("relation")))))

    return let(F.array_sort(_placed(groups_)), each)


def rank_band(groups_: Column, runner: Column, roster: Column) -> Column:
    """(min_rank, max_rank, missing, basis) that the runner may have; runners not observed, ``missing`` in number, may be ahead of it.

    Null where the runner isn't observed, the roster repeats itself or lacks an observed runner.
    """

    def band(gs: Column, i: Column) -> Column:
        g = F.get(gs, i)
        ahead = F.aggregate(F.slice(gs, F.lit(1), i), F.lit(0), lambda n, x: n + F.size(x["members"]))
        sure = F.coalesce(g["leader"] == runner, F.lit(False)) | (F.size(g["members"]) == 1)
        low = ahead + F.when(sure | g["leader"].isNull(), 1).otherwise(2)
        missing = F.size(F.array_except(roster, members(gs)))
        high = ahead + F.when(sure, 1).otherwise(F.size(g["members"])) + missing
        ok = i.isNotNull() & (F.size(F.array_distinct(roster)) == F.size(roster)) & (F.size(F.array_except(members(gs), roster)) == 0)
        return F.when(ok, F.struct(low.cast("int").alias("min_rank"), high.cast("int").alias("max_rank"), missing.cast("int").alias("missing"), F.lit(RANK_BASIS).alias("basis")))

    return let(groups_, lambda gs: let(_group_of(gs, runner), lambda i: band(gs, i)))


def rank_bands(groups_: Column, roster: Column) -> Column:
    """(runner, band) of every observed runner, in the order of groups: ``rank_band`` of all at once.

    What holds for the notation (who is missing, whether the roster fits) and for a group (how many are ahead) is worked out once.
    """

    def of_member(g: Column, ahead: Column, about: Column):
        def band(m: Column) -> Column:
            sure = F.coalesce(g["leader"] == m, F.lit(False)) | (F.size(g["members"]) == 1)
            low = ahead + F.when(sure | g["leader"].isNull(), 1).otherwise(2)
            high = ahead + F.when(sure, 1).otherwise(F.size(g["members"])) + about["missing"]
            told = F.struct(low.cast("int").alias("min_rank"), high.cast("int").alias("max_rank"), about["missing"].alias("missing"), F.lit(RANK_BASIS).alias("basis"))
            return F.struct(m.alias("runner"), F.when(about["ok"], told).alias("band"))

        return band

    def of_notation(gs: Column) -> Column:
        def known(ms: Column) -> Column:
            ok = (F.size(F.array_distinct(roster)) == F.size(roster)) & (F.size(F.array_except(ms, roster)) == 0)
            return F.struct(F.size(F.array_except(roster, ms)).alias("missing"), ok.alias("ok"), F.transform(gs, lambda g: F.size(g["members"])).alias("sizes"))

        def every(about: Column) -> Column:
            def of_group(g: Column, i: Column) -> Column:
                ahead = F.aggregate(F.slice(about["sizes"], F.lit(1), i), F.lit(0), lambda n, x: n + x)
                return let(ahead, lambda n: F.transform(g["members"], of_member(g, n, about)))

            return F.flatten(F.transform(gs, of_group))

        return let(let(members(gs), known), every)

    return let(groups_, of_notation)


def progress_band(before: Column, after: Column) -> Column:
    """(low, high, advanced, dropped, unresolved): places won between two rank bands; unresolved if they may be none."""
    low, high = before["min_rank"] - after["max_rank"], before["max_rank"] - after["min_rank"]
    return F.when(low.isNotNull(), F.struct(low.alias("low"), high.alias("high"), (low > 0).alias("advanced"), (high < 0).alias("dropped"), ((low <= 0) & (high >= 0)).alias("unresolved")))
