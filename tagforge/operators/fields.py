"""Fields of a tag from its recognized lines: name, prices and discount by layout zone.

Lines are an array of struct<bbox: 4 x 2 doubles, text: string, ...> in reading order.  Everything
is an expression on one row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagforge.functions import geometry, text
from tagforge.functions.text import let


def joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: text.text_of(x["text"])), " ")


def zone(lines: Column, width: Column, height: Column, top: bool, left: bool | None = None) -> Column:
    """Lines of one half or quarter of the tag."""
    def inside(x):
        ok = geometry.is_top(x["bbox"], height) == F.lit(top)
        return ok if left is None else ok & (geometry.is_left(x["bbox"], width) == F.lit(left))

    return F.filter(lines, inside)


def first_price(lines: Column) -> Column:
    """The price of the first line that has one, else ''."""
    prices = F.transform(lines, lambda x: text.extract_price(x["text"]))
    return F.coalesce(F.get(F.filter(prices, lambda p: p != ""), 0), F.lit(""))


def tallest_price(lines: Column) -> Column:
    """The price of the tallest line that has one (the first of equals; no height never wins), or null."""
    start = F.struct(F.lit(0.0).alias("height"), F.lit(None).cast("string").alias("price"))

    def step(best, x):
        height, price = geometry.extent(x["bbox"], 1), text.extract_price(x["text"])
        return F.when((price != "") & (height > best["height"]), F.struct(height.alias("height"), price.alias("price"))).otherwise(best)

    return F.aggregate(lines, start, step)["price"]


def first_number(lines: Column, pattern: str, percent: bool) -> Column:
    wanted = F.filter(lines, lambda x: text.text_of(x["text"]).contains("%")) if percent else lines
    return F.get(F.filter(F.transform(wanted, lambda x: text.found(x["text"], pattern)), lambda n: n.isNotNull()), 0)


def discount_of(number: Column) -> Column:
    """Struct amount (`-n%`) and price: a number over 100 is no discount but a price (its minus stays)."""
    def split(n):
        signed = F.when(n.startswith("-"), n).otherwise(F.concat(F.lit("-"), n))
        digits = F.regexp_replace(n, "^-", "")
        large = (F.length(digits) > 38) | (digits.try_cast("decimal(38,0)") > 100)
        return F.struct(F.when(n.isNull() | large, "").otherwise(F.concat(signed, F.lit("%"))).alias("amount"), F.when(large, signed).otherwise("").alias("price"))

    return let(number, split)


def discount(left_bottom: Column, bottom: Column) -> Column:
    """The discount by the first number before a percent sign on the left, any number there, or one before a percent sign."""
    return discount_of(F.coalesce(first_number(left_bottom, text.PERCENT, True), first_number(left_bottom, text.SIGNED, False), first_number(bottom, text.PERCENT, True)))


def sane_default(default: Column, reduced: Column) -> Column:
    """'' where the price before the discount is less than the one after it."""
    less = default.try_cast("double") < reduced.try_cast("double")
    return F.when(less, "").otherwise(default)


def measured(lines: Column, width: Column, height: Column, red: Column) -> Column:
    """Each line's text, price, center, height and zone, and the numbers of lower lines of red tags, all found once."""
    def line(x):
        words, top = text.text_of(x["text"]), geometry.is_top(x["bbox"], height)
        lower = red & ~top
        return F.struct(
            words.alias("text"), text.extract_price(words).alias("price"), geometry.center(x["bbox"], 1).alias("y"), geometry.extent(x["bbox"], 1).alias("tall"), top.alias("top"), geometry.is_left(x["bbox"], width).alias("left"),
            F.when(lower & words.contains("%"), text.found(words, text.PERCENT)).alias("percent"), F.when(lower, text.found(words, text.SIGNED)).alias("number"),
        )

    return F.transform(lines, line)


def first_of(lines: Column, name: str) -> Column:
    """The first value of that name that isn't missing, or null."""
    return F.get(F.filter(F.transform(lines, lambda x: F.nullif(x[name], F.lit(""))), lambda v: v.isNotNull()), 0)


def parse_fields(lines: Column, code_box: Column, color: Column, width: Column, height: Column, assume_99: bool = True) -> Column:
    """Struct product_name, price_default, price_card (always ''), price_discount, discount_amount."""
    ending = text.assume_kopecks if assume_99 else (lambda x: x)

    def default_price(found):
        code_end = F.array_max(geometry.axis(code_box, 1))
        below = lambda r: F.when(F.size(code_box) > 0, F.filter(r, lambda x: x["y"] > code_end))
        near = let(F.filter(found, lambda x: x["top"] & ~x["left"]), lambda r: let(below(r), lambda b: F.when(F.size(b) > 0, b).otherwise(r)))
        whole = F.when(color.isin("yellow", "unknown"), let(joined(found), text.extract_price))
        return F.coalesce(let(near, lambda n: first_of(n, "price")), whole, F.lit(""))

    def lower_part(found):
        """Struct price and amount of the lower half."""
        start = F.struct(F.lit(0.0).alias("tall"), F.lit(None).cast("string").alias("price"))
        higher = lambda best, x: F.when((x["price"] != "") & (x["tall"] > best["tall"]), F.struct(x["tall"].alias("tall"), x["price"].alias("price"))).otherwise(best)

        def of(part):
            left = F.filter(part, lambda x: x["left"])
            number = F.coalesce(first_of(left, "percent"), first_of(left, "number"), first_of(part, "percent"))
            right = lambda r: F.coalesce(F.aggregate(r, start, higher)["price"], first_of(r, "price"))
            price = let(F.filter(part, lambda x: ~x["left"]), right)
            return F.when(F.size(part) > 0, let(discount_of(number), lambda cut: F.struct(F.coalesce(price, cut["price"]).alias("price"), cut["amount"].alias("amount"))))

        return let(F.filter(found, lambda x: ~x["top"]), of)

    def told(x):
        before, after = ending(x["default"]), ending(F.coalesce(x["low"]["price"], F.lit("")))
        return F.struct(x["name"].alias("product_name"), sane_default(before, after).alias("price_default"), F.lit("").alias("price_card"), after.alias("price_discount"), F.coalesce(x["low"]["amount"], F.lit("")).alias("discount_amount"))

    def fields(found):
        name = text.strip(joined(F.filter(found, lambda x: x["top"] & x["left"])))
        low = F.when(color == "red", lower_part(found))
        return let(F.struct(name.alias("name"), default_price(found).alias("default"), low.alias("low")), told)

    return let(measured(lines, width, height, color == "red"), fields)
