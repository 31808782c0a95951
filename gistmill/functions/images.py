"""Tokens that images cost, and plans to make them cheaper, as native columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Providers' published constants: fixed values.
OPENAI_BASE, OPENAI_TILE_TOKENS, OPENAI_TILE, OPENAI_EDGE, OPENAI_SHORT = 85, 170, 512, 2048, 768
ANTHROPIC_PX, ANTHROPIC_EDGE, ANTHROPIC_CAP, ANTHROPIC_PIXELS = 750, 1568, 1600, 1_150_000
GOOGLE_TOKENS, GOOGLE_TILE, GOOGLE_EDGE = 258, 768, 1536
LEAST_SIDE = 16
ALIASES = {"gpt": "openai", "claude": "anthropic", "gemini": "google"}


def provider(name: Column) -> Column:
    low = F.lower(name)
    for alias, real in ALIASES.items():
        low = F.when(low == alias, real).otherwise(low)
    return F.when(low.isin("openai", "anthropic", "google"), low)


def _scaled(w: Column, h: Column, scale: Column) -> tuple[Column, Column]:
    def side(x: Column) -> Column:
        return F.when(scale >= 1.0, x).otherwise(F.greatest(F.lit(1), F.bround(x * scale).cast("long")))

    return side(w), side(h)


def _fit(w: Column, h: Column, edge: int) -> tuple[Column, Column]:
    return _scaled(w, h, F.least(F.lit(1.0), F.lit(edge) / F.greatest(w, h)))


def _let(f, **cols: Column) -> Column:
    """f over a struct of columns: a lambda's variable names a value once, where repeating its expression would grow the plan."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(k) for k, c in cols.items()])), f), F.lit(0))


def _openai_dims(w: Column, h: Column) -> Column:
    """struct<x, y>: fitted to a square of 2048, then the shorter side to 768."""
    x, y = _fit(w, h, OPENAI_EDGE)

    def short(s: Column) -> Column:
        a, b = _scaled(s["x"], s["y"], F.least(F.lit(1.0), F.lit(OPENAI_SHORT) / F.least(s["x"], s["y"])))
        return F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))

    return _let(short, x=x, y=y)


def _tiles(w: Column, h: Column, px: int) -> Column:
    return F.ceil(w / px) * F.ceil(h / px)


def tokens(w: Column, h: Column, prov: Column, detail: Column) -> Column:
    """Input tokens of a w x h image; null for an unknown provider, a side under 1 or an unknown detail."""

    def cost(s: Column) -> Column:
        low = (s["detail"] == "low") | ((s["detail"] == "auto") & (F.greatest(s["w"], s["h"]) <= OPENAI_TILE))
        aw, ah = _fit(s["w"], s["h"], ANTHROPIC_EDGE)
        n = (
            F.when((s["known"] == "openai") & low, OPENAI_BASE)
            .when(s["known"] == "openai", OPENAI_BASE + OPENAI_TILE_TOKENS * _let(lambda d: _tiles(d["d"]["x"], d["d"]["y"], OPENAI_TILE), d=_openai_dims(s["w"], s["h"])))
            .when(s["known"] == "anthropic", F.least(F.ceil(aw * ah / ANTHROPIC_PX), F.lit(ANTHROPIC_CAP)))
            .when(s["known"] == "google", GOOGLE_TOKENS * _tiles(s["w"], s["h"], GOOGLE_TILE))
        )
        return F.when((s["w"] >= 1) & (s["h"] >= 1) & s["detail"].isin("auto", "low", "high"), n).cast("long")

    return _let(cost, w=w.cast("long"), h=h.cast("long"), known=provider(prov), detail=detail)


def plan(w: Column, h: Column, prov: Column, target: Column, detail: Column) -> Column:
    """struct<strategy, width, height, before, after>: the cheapest reduction that stays useful. target may be null.

    Without a target, an image over its provider's sweet spot is scaled down to it. With one, the largest of nineteen
    scales (95 % to 5 %) that fits is taken; else openai falls back to low detail and others to the smallest scale.
    """

    def made(v: Column, strategy: str, x: Column, y: Column, after: Column) -> Column:
        return F.struct(F.lit(strategy).alias("strategy"), x.cast("long").alias("width"), y.cast("long").alias("height"), v["before"].alias("before"), after.cast("long").alias("after"))

    def sized(v: Column, x: Column, y: Column) -> Column:
        return _let(lambda d: F.struct(d["x"].alias("x"), d["y"].alias("y"), tokens(d["x"], d["y"], v["known"], v["fixed"]).alias("after")), x=x.cast("long"), y=y.cast("long"))

    def sweet(v: Column) -> Column:
        w, h = v["w"], v["h"]
        aw, ah = _scaled(w, h, F.least(F.lit(1.0), F.lit(ANTHROPIC_EDGE) / F.greatest(w, h), F.sqrt(F.lit(ANTHROPIC_PIXELS) / (w * h))))
        gw, gh = _fit(w, h, GOOGLE_EDGE)
        pair = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
        dims = F.when(v["known"] == "openai", _openai_dims(w, h)).when(v["known"] == "anthropic", pair(aw, ah)).otherwise(pair(gw, gh))
        return _let(lambda d: F.when((d["d"]["x"] == w) & (d["d"]["y"] == h), made(v, "passthrough", w, h, v["before"])).otherwise(
            _let(lambda e: made(v, "downscale", e["e"]["x"], e["e"]["y"], e["e"]["after"]), e=sized(v, d["d"]["x"], d["d"]["y"]))), d=dims)

    def budget(v: Column) -> Column:
        w, h = v["w"], v["h"]

        def choose(u: Column) -> Column:
            fits, last = F.get(F.filter(u["u"], lambda s: s["after"] <= v["target"]), F.lit(0)), F.get(u["u"], F.size(u["u"]) - 1)
            return _let(lambda c: F.when(c["fits"].isNotNull(), made(v, "downscale", c["fits"]["x"], c["fits"]["y"], c["fits"]["after"]))
                .when(v["known"] == "openai", made(v, "detail-low", w, h, F.lit(OPENAI_BASE)))
                .when(c["last"]["after"] < v["before"], made(v, "downscale", c["last"]["x"], c["last"]["y"], c["last"]["after"]))
                .otherwise(made(v, "passthrough", w, h, v["before"])), fits=fits, last=last)

        steps = F.transform(F.sequence(F.lit(19), F.lit(1), F.lit(-1)), lambda i: sized(v, *_scaled(w, h, i / 20)))
        return _let(choose, u=F.filter(steps, lambda s: F.least(s["x"], s["y"]) >= LEAST_SIDE))

    def decide(v: Column) -> Column:
        same = made(v, "passthrough", v["w"], v["h"], v["before"])
        return F.when(v["before"].isNotNull(), F.when(((v["known"] == "openai") & (v["fixed"] == "low")) | (v["before"] <= v["target"]), same).when(v["target"].isNull(), sweet(v)).otherwise(budget(v)))

    def priced(v: Column) -> Column:
        fixed = F.when((v["known"] == "openai") & (v["detail"] == "auto"), F.when(F.greatest(v["w"], v["h"]) <= OPENAI_TILE, "low").otherwise("high")).otherwise(v["detail"])
        before = tokens(v["w"], v["h"], v["known"], v["detail"])
        return _let(decide, w=v["w"], h=v["h"], known=v["known"], fixed=fixed, target=v["target"], before=before)

    return _let(priced, w=w.cast("long"), h=h.cast("long"), known=provider(prov), detail=detail, target=target)


def png_gif_size(data: Column) -> Column:
    """struct<width, height> from a PNG's or GIF's header; null for anything else."""
    hexed = F.hex(F.substring(data, 1, 24))
    at = lambda start, n: F.conv(F.substring(hexed, start, n), 16, 10).cast("int")
    little = lambda start: F.conv(F.concat(F.substring(hexed, start + 2, 2), F.substring(hexed, start, 2)), 16, 10).cast("int")
    png = F.struct(at(33, 8).alias("width"), at(41, 8).alias("height"))
    gif = F.struct(little(13).alias("width"), little(17).alias("height"))
    return F.when(hexed.startswith("89504E470D0A1A0A") & (F.length(hexed) == 48), png).when(hexed.startswith("474946383") & (F.length(hexed) >= 20), gif)


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def jpeg_size(data: pd.Series) -> pd.DataFrame:
    """The size in a JPEG's frame header, found by walking its segments; null for anything else."""
    def of(b):
        if not b or b[:2] != b"\xff\xd8":
            return None, None
        at = 2
        while at + 9 <= len(b) and b[at] == 0xFF:
            if 0xC0 <= b[at + 1] <= 0xCF and b[at + 1] not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
            at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
        return None, None

    return pd.DataFrame([of(x) for x in data], columns=["width", "height"], dtype="Int32")
