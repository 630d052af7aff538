"""Personal information inside free text (problem 3): information-theoretic sanitisation.

``candidates`` cuts every stretch that could be an entity out of a text, with the terms that stand
for it: its shape, its parts and its neighbours.  ``disclosure`` counts over the whole corpus how
often each term stands with an entity that is sure and how often at all; their pointwise mutual
information is how many bits the term tells about an entity of that kind.  Candidates whose terms
together disclose more than a threshold are generalised to their type, a placeholder.  Sure is an
entity by what stands beside it or by what only such an entity can be (a check of its digits), never by
the pattern that cut it.  The counting is repeated once, with what the first count found, so that
neighbours of entities count and not only those of the seeds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.tables import staged

#: Common Chinese family names.
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方"
    "白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔向汤温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包"
    "宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷盛曲翁冉骆蓝路游辛靳管柴蒙鲍华喻祁蒲房滕屈饶解牟艾尤阳时穆农司卓古吉缪简车项连芦麦褚娄窦戚岑景党宫"
    "费卜冷晏席卫米柏宗瞿桂全佟应臧闵苟邬边卞姬师和仇栾隋商刁沙荣巫寇桑郎甄丛仲虞敖巩明佘池查麻苑迟邝傅洪"
)
#: Family names of two characters.
LONG_SURNAMES = "欧阳 司马 上官 诸葛 东方 皇甫 尉迟 公孙 慕容 令狐 长孙 宇文 司徒 夏侯 端木 南宫 独孤 申屠 濮阳 淳于".split()


@dataclass(frozen=True)
class Own:
    """What is nobody's but the owner's of the texts: domains of mail addresses, and a pattern of telephone numbers."""

    domains: tuple[str, ...] = ()
    numbers: str = r"(?!)"


#: Share of all candidates beyond which a term is a hot key.
HOT_SHARE = 0.001

CANDIDATES = "kind string, begin int, end int, text string, seed boolean, terms array<string>"
#: Bits above which a candidate is disclosed, by kind; names in Latin letters are counted by themselves.
THRESHOLD_BITS = {"email": -1.0, "phone": 0.0, "idno": 0.0, "address": -1.0, "name": 1.0, "name_latin": 0.0}
#: No shape takes more bits than this from a candidate.
SHAPE_BITS = 6.0
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "idno": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

_HAN_DIGITS = "零〇幺一二两三四五六七八九"
_NUMERAL = {ord(c): d for c, d in zip(_HAN_DIGITS, "0011223456789")}

_LOCAL, _LABEL = r"(?<![a-z0-9._%+-])[a-z0-9](?:[a-z0-9_%+-]|\.(?=[a-z0-9]))*", r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_AT = r"(?:\s?@\s?|\s?[\[(<{]\s?at\s?[\])>}]\s?|\s?艾特\s?)"
_DOT = r"(?:[.。点]|\s?[\[(<{]\s?dot\s?[\])>}]\s?|\s+dot\s+)"
# a bare "at" is one only with a spelled "dot" after it
_MAIL = re.compile(rf"{_LOCAL}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}|\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL})*\s+dot\s+)[a-z]{{2,}}(?![a-z0-9])", re.I)
_DIGITS = re.compile(r"(?<![0-9a-zA-Z])(?:[a-zA-Z]{1,3})?(?:\(?\+\s?\d{1,3}\)?[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d(?:[ .-]?\d){6,24}[ .-]?[xX]?(?![0-9a-zA-Z])")
_SPOKEN = re.compile(rf"[{_HAN_DIGITS}](?:[ -]?[{_HAN_DIGITS}]){{8,17}}")
_NUMBER_CN = r"[0-9零〇一二两三四五六七八九十百千]+"
_STREET_CN = re.compile(
    rf"(?:[一-鿿]{{2}}(?:省|自治区))?\s?(?:[一-鿿]{{2}}[市州])?\s?(?:[一-鿿]{{2}}[区县])?\s?"
    rf"(?:(?![省市区县])[一-鿿]){{1,4}}?(?:大道|东路|西路|南路|北路|东街|西街|南街|北街|路|街|巷|胡同|里弄)\s?(?:{_NUMBER_CN}\s?(?:弄|巷)\s?)?{_NUMBER_CN}\s?(?:号院|号楼|号|弄|栋|幢)"
    rf"(?:[ 　]?(?:{_NUMBER_CN}\s?[号栋幢座楼室层]+|[一-鿿]{{2,6}}(?=\s?\d)|{_NUMBER_CN}\s?(?:单元|号楼|弄)|\d{{1,4}}(?:-\d{{1,4}})*(?!\d)))*"
)
_STREET_KIND = (
    "street|st|avenue|ave|road|rd|drive|dr|court|ct|close|row|lane|ln|way|place|pl|boulevard|blvd|terrace|square|crescent|hill|parade|gardens|grove|walk|quay|alley|mews|path|circle|highway|parkway"
)
_STREET_EN = re.compile(
    rf"(?<![\w.-])(?:no\.?\s?)?\d{{1,5}}[a-z]?\s+(?:[a-z][a-z'-]+\s+){{1,3}}?(?:{_STREET_KIND})\b\.?(?:,?\s*(?:flat|apt|apartment|unit|suite|#)\.?\s?#?\w+)?(?:,\s*[A-Z][a-z]+(?:\s[A-Z][a-z]+)?(?:\s+\d{{4,6}})?)?",
    re.I,
)
_NAME_CN = re.compile(rf"(?=([{SURNAMES}][一-鿿]{{1,2}}))")
_NAME_CN_LONG = re.compile(rf"(?=((?:{'|'.join(LONG_SURNAMES)})[一-鿿]{{1,2}}))")
_LEAD_CN = re.compile(r"(?:麻烦|请)?(?:(?:邮寄|寄|送)[到给]?|住在?|搬到|改到|改成|就?在|到)")
#: Places with a number that have no word of a street: what makes addresses telling.
_PLACE_CN = re.compile(rf"(?<![一-鿿])[一-鿿]{{2,6}}?([一-鿿])\s?{_NUMBER_CN}\s?(?:号|弄|栋|幢|室|楼)")
_PLACE_EN = re.compile(r"(?<![\w.-])\d{1,5}\s+[A-Z][a-z'-]+(?:\s[A-Z][a-z'-]+)?(?![\w-])")
_HANDLE = re.compile(r"(?<![\w.@])[a-z0-9._-]+@[a-z0-9-]+(?![\w.@-])", re.I)
_CUE_ADDRESS = re.compile(r"(?:地址|住址|寄|邮寄|送|寄到|送到|住|住在|取件去|家|搬到|改到)(?:改成|改到|是|到|在)?[\s：:，,]{0,3}$|\b(?:address is|address:?|moved to|live at|lives at|(?:ship|send|deliver|drop) (?:it )?to|up from|(?:leave|deliver|drop|send) it (?:at|to))\s+$", re.I)
_CUE_MAIL = re.compile(r"(?:邮箱|邮件|邮件地址|登录账号|账号|e-?mail|mail|account|invoice to|reach me at|write me at|contact me at)(?:[\s:：是为]|好像|is|地址|改成)*$", re.I)
_NAME_CUE_CN = re.compile(r"(?:我叫|我是|名字叫|姓名[:： ]*|收件人[:： ]*|联系人[:： ]*|收货人[:： ]*|抬头个人[，, ]*|—— ?|麻烦写|会员名改回)$")
_WORD = r"[A-Z][a-zA-Z'’]*(?:-[A-Z][a-zA-Z'’]*)*"
_NAME_EN = re.compile(rf"(?<![\w@.-])(?=({_WORD})\s+({_WORD})(?![\w@]))")
_NAME_EN_LONG = re.compile(rf"(?<![\w@.-])(?=({_WORD})\s+({_WORD})\s+({_WORD})(?![\w@]))")
_NAME_CUE_EN = re.compile(r"\b(?:my name is|this is|ordered by|refund goes to|goes to|ask for|thanks,|regards,|i am|i'm|my (?:wife|husband|neighbour|neighbor|colleague|flatmate|sister|brother|mother|father|son|daughter|partner|friend))\s+$", re.I)
_AFTER_CUE_EN = re.compile(r"\b(?:my name is|this is|ordered by|refund goes to|ask for|thanks,|regards,|my (?:wife|husband|neighbour|neighbor|colleague|flatmate))\s+(?=([a-z][a-z'’]*(?:-[a-z'’]+)?)\s+([a-z][a-z'’]*(?:-[a-z'’]+)?)(?![\w@]))", re.I)
_CUE_PHONE = re.compile(r"(?:电话|手机|号码|微信|联系|致电|打|换号|现在用|短信发到|call|phone|ring|text|number|mobile|tel)\W{0,4}[^\d]{0,10}$", re.I)
_CUE_ID = re.compile(r"(?:身份证|证件|实名|报关|清关|ssn|tax form|id no|passport|personal number)[^\d]{0,16}$", re.I)


def _flat(text: str) -> str:
    """Same length as the text: full-width forms, odd spaces and dashes as their plain characters, invisible ones as spaces."""
    out = []
    for ch in text:
        if ch < "\x80":
            out.append(ch)
            continue
        n = unicodedata.normalize("NFKC", ch)
        n = n if len(n) == 1 else ch
        kind = unicodedata.category(n)
        out.append("-" if kind == "Pd" and n != "—" else " " if kind in ("Zs", "Cf") else n)
    return "".join(out)


def _around(text: str, a: int, b: int) -> list[str]:
    left, right = text[max(0, a - 12) : a], text[b : b + 12]
    word = re.search(r"([A-Za-z]+)\W*$", left)
    before = word.group(1).lower() if word else re.sub(r"[\W\d]+", "", left)[-2:]
    after = re.match(r"\W*([A-Za-z]+)", right)
    behind = after.group(1).lower() if after else re.sub(r"[\W\d]+", "", right)[:2]
    return [f"l:{before}", f"r:{behind}"]


def _digit_shape(raw: str, digits: str) -> tuple[str, str]:
    """(kind that the digits could be, shape)."""
    bare = digits
    for prefix in ("0086", "86"):
        if digits.startswith(prefix) and len(digits) == len(prefix) + 11:
            bare = digits[len(prefix) :]
    if re.match(r"[a-zA-Z]", raw):
        return "phone", f"coded{len(digits)}"
    if re.fullmatch(r"(?:1[1-5]|2[1-3]|3[1-7]|4[1-6]|5[0-4]|6[1-5]|71|8[12])\d{4}(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]", digits):
        return "idno", "cn18"
    if len(bare) == 11 and re.fullmatch(r"1[3-9]\d{9}", bare):
        return "phone", "cn11" if bare == digits or raw.lstrip("(").startswith(("+86", "0086")) else "cn11plain86"
    if raw.lstrip("(").startswith("+") and 9 <= len(digits) <= 14:
        return "phone", "plus"
    if len(digits) in (10, 11) and re.fullmatch(r"1?[2-9]\d{2}555\d{4}", digits):
        return "phone", "us10"
    if re.fullmatch(r"1?\(?[2-9]\d{2}\)?[ .-]\d{3}[ .-]\d{4}", raw):
        return "phone", "us334"
    if re.fullmatch(r"07\d{3} ?\d{6}|0\d{2,4}[ -]\d{3,4}[ -]?\d{4}|020 ?\d{4} ?\d{4}", raw):
        return "phone", "trunk"
    if re.fullmatch(r"\d{3}[ -]\d{2}[ -]\d{4}", raw):
        return "idno", "s324"
    if len(digits) == 9:
        return "idno", "s9" + ("p" if re.match(r"9|666", digits) else "o")
    return ("idno" if len(digits) >= 15 else "phone"), f"len{len(digits)}"


def find_candidates(text: str, own: Own = Own()) -> list[tuple]:
    flat, out, taken = _flat(text), [], []

    def cued(cue: re.Pattern, a: int) -> bool:
        return bool(cue.search(flat[max(0, a - 24) : a]))

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    for m in _MAIL.finditer(flat):
        a, b = m.span()
        taken.append((a, b))
        domain = re.split(rf"{_AT}|\s+at\s+", m.group().lower())[-1]
        domain = re.sub(r"\s+|[\[({<\])}>]", "", re.sub(_DOT, ".", domain))
        owners = any(domain == d or domain.endswith("." + d) for d in own.domains)
        shape = ["own:mail"] if owners else ["s:mail", f"tld:{domain.rpartition('.')[2]}"]
        out.append(("email", a, b, text[a:b], not owners and cued(_CUE_MAIL, a), [*shape, *_around(flat, a, b)]))
    for m in _HANDLE.finditer(flat):
        a, b = m.span()
        if free(a, b):
            taken.append((a, b))
            out.append(("email", a, b, text[a:b], False, ["s:handle", *_around(flat, a, b)]))
    for m in re.finditer(own.numbers, flat):
        taken.append(m.span())
    for m in _STREET_CN.finditer(flat):
        a, b = m.span()
        lead = _LEAD_CN.match(flat, a, b)
        if lead and _STREET_CN.fullmatch(flat, lead.end(), b):
            a = lead.end()  # what leads to the address is no part of it
        if free(a, b):
            taken.append((a, b))
            kind = re.search(rf"(大道|胡同|里弄|[路街巷])\s?(?:{_NUMBER_CN}\s?(?:弄|巷)\s?)?{_NUMBER_CN}", m.group())
            out.append(("address", a, b, text[a:b], cued(_CUE_ADDRESS, a), ["s:cn", f"street:{kind.group(1) if kind else ''}", *_around(flat, a, b)]))
    for m in _STREET_EN.finditer(flat):
        a, b = m.span()
        if free(a, b):
            taken.append((a, b))
            kind = re.search(rf"\b({_STREET_KIND})\b", m.group(), re.I).group().lower()
            out.append(("address", a, b, text[a:b], cued(_CUE_ADDRESS, a), ["s:en", f"street:{kind}", *_around(flat, a, b)]))
    for pattern, shape in ((_PLACE_CN, "cn"), (_PLACE_EN, "en")):
        for m in pattern.finditer(flat):
            a, b = m.span()
            if free(a, b):  # nothing is taken from the digits: they can still be a number of another kind
                word = m.group(1) if shape == "cn" else m.group().split()[-1].lower()
                out.append(("address", a, b, text[a:b], False, [f"s:{shape}?", f"street:{word}", *_around(flat, a, b)]))
    for pattern in (_DIGITS, _SPOKEN):
        for m in pattern.finditer(flat):
            a, b = m.span()
            while flat[b - 1] in " .-":
                b -= 1
            if not free(a, b):
                continue
            raw = flat[a:b]
            parts = [(a, b)]
            if pattern is _DIGITS and " " in raw and len(re.sub(r"\D", "", raw)) > 13:
                parts = [(a + p.start(), a + p.end()) for p in re.finditer(r"\d{6} \d{8} \d{3}[\dxX]|\+?\d{1,3} \d{3,5} \d{4} \d{4}|\d{3} \d{4} \d{4}(?!\d)|\S+", raw)]
            for x, y in parts:
                raw = flat[x:y]
                digits = re.sub(r"[^0-9Xx]", "", raw.translate(_NUMERAL)) if pattern is _SPOKEN or not re.match("[a-zA-Z]", raw) else re.sub(r"\D", "", raw)
                if len(digits) < 7:
                    continue
                kind, shape = _digit_shape(raw if pattern is _DIGITS else digits, digits)
                tail = re.match(r"\s?(?:转|ext\.?)\s?\d+", flat[y:])
                y2 = y + tail.end() if tail else y
                cue = bool((_CUE_PHONE if kind == "phone" else _CUE_ID).search(flat[max(0, x - 24) : x]))
                formed = pattern is _SPOKEN or bool(re.search(r"\d[ .-]\d", raw))
                solid = shape in ("cn18", "plus") or (shape in ("cn11", "us10", "us334", "trunk", "s324", "s9p") and (cue or formed and shape != "s9p"))
                taken.append((x, y2))
                out.append((kind, x, y2, text[x:y2], solid, [f"s:{shape}" + (":spoken" if pattern is _SPOKEN else ""), *_around(flat, x, y)]))
    for m in [*_NAME_CN.finditer(flat), *_NAME_CN_LONG.finditer(flat)]:
        a, family = m.start(), 1 if m.re is _NAME_CN else 2
        for length in range(family + 1, len(m.group(1)) + 1):
            b = a + length
            if not free(a, b):
                continue
            left, right = flat[:a], flat[b : b + 1]
            closed = not right or not "一" <= right <= "鿿"
            start = not left or not "一" <= left[-1] <= "鿿"
            sure = closed and bool(_NAME_CUE_CN.search(left[-8:]))
            given = [f"g:{c}" for c in flat[a + family : b]]
            sides = [f"l:{re.sub(r'[^一-鿿]', '', left[-2:]) or '|'}", f"r:{re.sub(r'[^一-鿿]', '', flat[b : b + 2]) if not closed else '|'}"]
            out.append(("name", a, b, text[a:b], sure, ["s:" + ("free" if start and closed else "open" if start or closed else "inside"), *given, *sides]))
    seen = set()
    for m in [*_NAME_EN.finditer(flat), *_AFTER_CUE_EN.finditer(flat), *_NAME_EN_LONG.finditer(flat)]:
        a, b = m.start(1), m.end(m.re.groups)
        if (a, b) in seen or not free(a, b):
            continue
        seen.add((a, b))
        # three words teach nothing: the third can be any word with a capital
        sure = m.re.groups == 2 and bool(_NAME_CUE_EN.search(flat[max(0, a - 30) : a]))
        out.append(("name_latin", a, b, text[a:b], sure, ["s:latin", *[f"g:{w.lower()}" for w in m.groups()], f"l:{_around(flat, a, b)[0][2:]}"]))
    return out


def candidates(messages: DataFrame, id_col: str, text_col: str, own: Own = Own()) -> DataFrame:
    """id plus CANDIDATES: every stretch that could be an entity.  Null and blank texts have none; repeated rows count once."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *c) for i, t in zip(pdf["id"], pdf["text"]) for c in find_candidates(t, own)]
            yield pd.DataFrame(rows, columns=["id", *[c.split()[0] for c in CANDIDATES.split(", ")]])

    once = messages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.trim("text") != "").distinct()
    return once.mapInPandas(cut, f"id {messages.schema[id_col].dataType.simpleString()}, {CANDIDATES}")


def disclosure(cands: DataFrame, marked: str) -> DataFrame:
    """kind, term, bits: the pointwise mutual information between a term and a sure entity of its kind,
    from the counts of the whole corpus, smoothed by one sighting at the kind's own rate."""
    counts = cands.select("kind", F.col(marked).cast("long").alias("sure"), F.explode("terms").alias("term")).groupBy("kind", "term").agg(F.count("*").alias("n"), F.sum("sure").alias("k"))
    base = cands.groupBy("kind").agg(((F.sum(F.col(marked).cast("long")) + 0.01) / (F.count("*") + 1)).alias("rate"))
    return counts.join(F.broadcast(base), "kind").select("kind", "term", F.log2((F.col("k") + F.col("rate")) / (F.col("n") + 1) / F.col("rate")).alias("bits"), "n")


def _with_bits(each: DataFrame, bits: DataFrame, total: int) -> DataFrame:
    """Terms of candidates with their bits.  Terms of more than HOT_SHARE of all candidates are hot keys; there are at most (terms of a
    candidate) / HOT_SHARE, so they are broadcast; the others are joined by shuffle, without the rows of the hot ones."""
    hot = bits.where(F.col("n") > HOT_SHARE * total).select("kind", "term", F.col("bits").alias("hot"))
    marked = each.join(F.broadcast(hot), ["kind", "term"], "left")
    rest = marked.where("hot is null").drop("hot").join(bits.where(F.col("n") <= HOT_SHARE * total).drop("n"), ["kind", "term"])
    return marked.where("hot is not null").withColumnRenamed("hot", "bits").unionByName(rest)


def scored(cands: DataFrame, rounds: int = 2) -> DataFrame:
    """Candidates with ``bits``, what their terms disclose together, and ``found``, whether that exceeds the threshold of their kind."""
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in THRESHOLD_BITS.items()])
    key = ["c1", "c2"]  # 128 bits tell candidates apart
    cands = staged(cands.withColumns({c: F.xxhash64(F.lit(c), "id", "kind", "begin", "end", "text") for c in key}), "candidates")
    total = cands.count()
    marked = cands.withColumn("found", F.col("seed"))
    for _ in range(rounds):
        bits = staged(disclosure(marked, "found"), "bits")
        each = _with_bits(cands.select(*key, "kind", F.explode("terms").alias("term")), bits, total)
        # terms of one sort are averaged; a neighbour can only add bits, shapes and parts can also take some;
        # no neighbours make a name of parts that are none, and a name of three parts needs three that are some
        sort = F.substring_index("term", ":", 1)
        each = each.withColumn("bits", F.when(sort.isin("l", "r"), F.greatest("bits", F.lit(0.0))).when(sort == "s", F.greatest("bits", F.lit(-SHAPE_BITS))).otherwise(F.col("bits")))
        sorts = each.groupBy(*key, sort.alias("sort")).agg(F.avg("bits").alias("bits"), F.min("bits").alias("least"), F.count("*").alias("n"))
        whole = sorts.groupBy(*key).agg(F.sum("bits").alias("bits"), F.max(F.when(F.col("sort") == "g", F.when(F.col("n") > 2, F.col("least")).otherwise(F.col("bits")))).alias("parts"))
        marked = staged(cands.join(whole, key).withColumn("found", (F.col("bits") > limit) & (F.coalesce("parts", F.lit(1.0)) > 0)), "scored")
    return marked.drop(*key, "parts")


def entities(messages: DataFrame, id_col: str, text_col: str, own: Own = Own()) -> DataFrame:
    """id, kind, begin, end, text, bits: the disclosed entities, the widest one where names overlap."""
    found = scored(candidates(messages, id_col, text_col, own)).where("found")
    kind = F.when(F.col("kind") == "name_latin", "name").otherwise(F.col("kind"))
    return found.select("id", kind.alias("kind"), "begin", "end", "text", "bits").distinct()


def sanitise(messages: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """id, clean, n_entities: each distinct text with a typed placeholder for every entity.

    Texts without entities, null and blank ones come out as they are.  Overlapping entities give one
    placeholder, of the longest one.
    """
    spans = found.groupBy("id").agg(F.collect_list(F.struct("begin", "end", "kind", "bits")).alias("spans"))
    once = messages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, spans in zip(pdf["id"], pdf["text"], pdf["spans"]):
                kept: list = []
                for s in sorted(spans if spans is not None else [], key=lambda s: (s["begin"] - s["end"], -s["bits"], s["begin"])):
                    if all(s["end"] <= k["begin"] or s["begin"] >= k["end"] for k in kept) and text:
                        kept.append(s)
                clean = text
                for s in sorted(kept, key=lambda s: -s["begin"]):
                    clean = clean[: s["begin"]] + PLACEHOLDERS[s["kind"]] + clean[s["end"] :]
                rows.append((i, clean, len(kept)))
            yield pd.DataFrame(rows, columns=["id", "clean", "n_entities"])

    return once.join(spans, "id", "left").mapInPandas(replace, f"id {messages.schema[id_col].dataType.simpleString()}, clean string, n_entities int")
