"""Colours: parsing, and conversion between RGB and YUV, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The CSS colour names.
NAMES = {
    "aliceblue": "f0f8ff", "antiquewhite": "faebd7", "aqua": "00ffff", "aquamarine": "7fffd4", "azure": "f0ffff", "beige": "f5f5dc",
    "bisque": "ffe4c4", "black": "000000", "blanchedalmond": "ffebcd", "blue": "0000ff", "blueviolet": "8a2be2", "brown": "a52a2a",
    "burlywood": "deb887", "cadetblue": "5f9ea0", "chartreuse": "7fff00", "chocolate": "d2691e", "coral": "ff7f50", "cornflowerblue": "6495ed",
    "cornsilk": "fff8dc", "crimson": "dc143c", "cyan": "00ffff", "darkblue": "00008b", "darkcyan": "008b8b", "darkgoldenrod": "b8860b",
    "darkgray": "a9a9a9", "darkgreen": "006400", "darkgrey": "a9a9a9", "darkkhaki": "bdb76b", "darkmagenta": "8b008b", "darkolivegreen": "556b2f",
    "darkorange": "ff8c00", "darkorchid": "9932cc", "darkred": "8b0000", "darksalmon": "e9967a", "darkseagreen": "8fbc8f", "darkslateblue": "483d8b",
    "darkslategray": "2f4f4f", "darkslategrey": "2f4f4f", "darkturquoise": "00ced1", "darkviolet": "9400d3", "deeppink": "ff1493",
    "deepskyblue": "00bfff", "dimgray": "696969", "dimgrey": "696969", "dodgerblue": "1e90ff", "firebrick": "b22222", "floralwhite": "fffaf0",
    "forestgreen": "228b22", "fuchsia": "ff00ff", "gainsboro": "dcdcdc", "ghostwhite": "f8f8ff", "gold": "ffd700", "goldenrod": "daa520",
    "gray": "808080", "green": "008000", "greenyellow": "adff2f", "grey": "808080", "honeydew": "f0fff0", "hotpink": "ff69b4", "indianred": "cd5c5c",
    "indigo": "4b0082", "ivory": "fffff0", "khaki": "f0e68c", "lavender": "e6e6fa", "lavenderblush": "fff0f5", "lawngreen": "7cfc00",
    "lemonchiffon": "fffacd", "lightblue": "add8e6", "lightcoral": "f08080", "lightcyan": "e0ffff", "lightgoldenrodyellow": "fafad2",
    "lightgray": "d3d3d3", "lightgreen": "90ee90", "lightgrey": "d3d3d3", "lightpink": "ffb6c1", "lightsalmon": "ffa07a", "lightseagreen": "20b2aa",
    "lightskyblue": "87cefa", "lightslategray": "778899", "lightslategrey": "778899", "lightsteelblue": "b0c4de", "lightyellow": "ffffe0",
    "lime": "00ff00", "limegreen": "32cd32", "linen": "faf0e6", "magenta": "ff00ff", "maroon": "800000", "mediumaquamarine": "66cdaa",
    "mediumblue": "0000cd", "mediumorchid": "ba55d3", "mediumpurple": "9370db", "mediumseagreen": "3cb371", "mediumslateblue": "7b68ee",
    "mediumspringgreen": "00fa9a", "mediumturquoise": "48d1cc", "mediumvioletred": "c71585", "midnightblue": "191970", "mintcream": "f5fffa",
    "mistyrose": "ffe4e1", "moccasin": "ffe4b5", "navajowhite": "ffdead", "navy": "000080", "oldlace": "fdf5e6", "olive": "808000",
    "olivedrab": "6b8e23", "orange": "ffa500", "orangered": "ff4500", "orchid": "da70d6", "palegoldenrod": "eee8aa", "palegreen": "98fb98",
    "paleturquoise": "afeeee", "palevioletred": "db7093", "papayawhip": "ffefd5", "peachpuff": "ffdab9", "peru": "cd853f", "pink": "ffc0cb",
    "plum": "dda0dd", "powderblue": "b0e0e6", "purple": "800080", "rebeccapurple": "663399", "red": "ff0000", "rosybrown": "bc8f8f",
    "royalblue": "4169e1", "saddlebrown": "8b4513", "salmon": "fa8072", "sandybrown": "f4a460", "seagreen": "2e8b57", "seashell": "fff5ee",
    "sienna": "a0522d", "silver": "c0c0c0", "skyblue": "87ceeb", "slateblue": "6a5acd", "slategray": "708090", "slategrey": "708090",
    "snow": "fffafa", "springgreen": "00ff7f", "steelblue": "4682b4", "tan": "d2b48c", "teal": "008080", "thistle": "d8bfd8", "tomato": "ff6347",
    "turquoise": "40e0d0", "violet": "ee82ee", "wheat": "f5deb3", "white": "ffffff", "whitesmoke": "f5f5f5", "yellow": "ffff00",
    "yellowgreen": "9acd32",
}
#: Luma and chroma weights of BT.709, and the limited range as (scale, foot).
TO_YUV = ((0.2126, 0.7152, 0.0722), (-0.1146, -0.3854, 0.5), (0.5, -0.4542, -0.0458))
TO_RGB = ((0.0, 1.5748), (-0.1873, -0.4681), (1.8556, 0.0))
LUMA_SCALE, CHROMA_SCALE, FOOT = 219 / 255, 224 / 255, 16 / 255


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _channel(x: Column, base: int) -> Column:
    digits = "^[0-9a-fA-F]{1,2}$" if base == 16 else "^[0-9]{1,3}$"
    value = F.conv(F.trim(x), base, 10).cast("int")
    return F.when(F.trim(x).rlike(digits) & (value <= 255), value)


def parse_color(text: Column) -> Column:
    """Struct (r, g, b, a) of whole numbers up to 255, null for what isn't a colour.

    Names, #RRGGBB, #RRGGBBAA, rgb(r, g, b) and rgba(r, g, b, a) with a from 0 to 1.
    """
    s = F.trim(text)
    named = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])[s]
    hexadecimal = F.coalesce(F.concat(F.lit("#"), named), F.when(s.rlike("^#(?:.{6}|.{8})$"), s))
    part = lambda i: _channel(F.substring(hexadecimal, 2 + 2 * i, 2), 16)
    from_hex = F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"), F.when(F.length(hexadecimal) == 9, part(3)).otherwise(255).alias("a"))
    bare = F.regexp_extract(s, r"^rgba?\(([^)]*)\)?$", 1)
    items = F.split(bare, ",")
    item = lambda i: _channel(F.get(items, F.lit(i)), 10)
    alpha_text = F.get(items, F.lit(3))
    alpha = F.when(alpha_text.rlike(r"^[0-9]*\.?[0-9]+$"), alpha_text.cast("double"))
    alpha = F.when(alpha.between(0, 1), F.round(alpha * 255).cast("int"))
    rgba = s.startswith("rgba(")
    from_list = F.struct(item(0).alias("r"), item(1).alias("g"), item(2).alias("b"), F.when(rgba, alpha).otherwise(255).alias("a"))
    size = F.when(rgba, 4).otherwise(3)
    out = F.when(hexadecimal.isNotNull(), from_hex).when(s.startswith("rgb(") | rgba, F.when(F.size(items) == size, from_list))
    whole = out["r"].isNotNull() & out["g"].isNotNull() & out["b"].isNotNull() & out["a"].isNotNull()
    return F.when(whole, out)


def rgb_to_yuv(r: Column, g: Column, b: Column) -> Column:
    """Channels up to 255 to limited-range YUV from 0 to 1."""
    c = [x / 255.0 for x in (r, g, b)]
    y, u, v = (sum((F.lit(w) * x for w, x in zip(row[1:], c[1:], strict=True)), F.lit(row[0]) * c[0]) for row in TO_YUV)
    return F.struct(_clamp(y * LUMA_SCALE + FOOT).alias("y"), _clamp((u + 0.5) * CHROMA_SCALE + FOOT).alias("u"), _clamp((v + 0.5) * CHROMA_SCALE + FOOT).alias("v"))


def yuv_to_rgb(y: Column, u: Column, v: Column, limited: bool = True) -> Column:
    """YUV from 0 to 1 to RGB from 0 to 1."""
    if limited:
        y = _clamp((y - FOOT) / LUMA_SCALE)
        u, v = (_clamp((x - FOOT) / CHROMA_SCALE) for x in (u, v))
    return F.struct(*[_clamp(y + F.lit(a) * (u - 0.5) + F.lit(b) * (v - 0.5)).alias(n) for n, (a, b) in zip("rgb", TO_RGB, strict=True)])


def premultiplied(color: Column) -> Column:
    return F.struct(*[(color[c] * color["a"] / 255.0).alias(c) for c in "rgb"], color["a"].alias("a"))


def unpremultiplied(color: Column) -> Column:
    return F.struct(*[F.when(color["a"] > 0, color[c] * 255.0 / color["a"]).otherwise(0.0).alias(c) for c in "rgb"], color["a"].alias("a"))


def frame_rate(text: Column) -> Column:
    """Struct (num, den) of "NUM/DEN" or a whole number, null if it is neither or den is 0."""
    parts = F.split(F.trim(text), "/")
    num, den = (F.try_to_number(F.trim(F.get(parts, F.lit(i))), F.lit("9999999999")).cast("long") for i in (0, 1))
    ok = F.trim(text).rlike(r"^[0-9]{1,10}\s*(?:/\s*[0-9]{1,10})?$")
    den = F.when(F.size(parts) == 2, den).otherwise(1)
    return F.when(ok & (den > 0), F.struct(num.alias("num"), den.alias("den")))
