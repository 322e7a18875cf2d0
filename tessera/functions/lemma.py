"""Lemma normalisation between spelling variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.types import Language, Locale

#: British and American spellings, by the British one.
SPELLINGS = {
    "aluminium": "aluminum",
    "analyse": "analyze",
    "analysed": "analyzed",
    "analyses": "analyzes",
    "analysing": "analyzing",
    "apologise": "apologize",
    "apologised": "apologized",
    "artefact": "artifact",
    "artefacts": "artifacts",
    "behaviour": "behavior",
    "behavioural": "behavioral",
    "behaviours": "behaviors",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "catalogues": "catalogs",
    "centre": "center",
    "centred": "centered",
    "centres": "centers",
    "colour": "color",
    "coloured": "colored",
    "colours": "colors",
    "cosy": "cozy",
    "defence": "defense",
    "defences": "defenses",
    "enrol": "enroll",
    "favourite": "favorite",
    "favourites": "favorites",
    "fibre": "fiber",
    "fibres": "fibers",
    "fuelled": "fueled",
    "fulfil": "fulfill",
    "grey": "gray",
    "honour": "honor",
    "honoured": "honored",
    "honours": "honors",
    "jewellery": "jewelry",
    "kerb": "curb",
    "labelled": "labeled",
    "labour": "labor",
    "litre": "liter",
    "litres": "liters",
    "marvellous": "marvelous",
    "metre": "meter",
    "metres": "meters",
    "modelling": "modeling",
    "mould": "mold",
    "moulds": "molds",
    "offence": "offense",
    "offences": "offenses",
    "organisation": "organization",
    "organisations": "organizations",
    "organise": "organize",
    "organised": "organized",
    "plough": "plow",
    "programme": "program",
    "programmes": "programs",
    "pyjamas": "pajamas",
    "realise": "realize",
    "realised": "realized",
    "recognise": "recognize",
    "recognised": "recognized",
    "skilful": "skillful",
    "smoulder": "smolder",
    "speciality": "specialty",
    "storey": "story",
    "storeys": "stories",
    "travelled": "traveled",
    "travelling": "traveling",
    "tyre": "tire",
    "tyres": "tires",
    "wilful": "willful",
}

#: Some characters whose simplified form is common; a full table (traditional to simplified) is a parameter.
SIMPLIFIED = {
    "認": "认",
    "識": "识",
    "國": "国",
    "學": "学",
    "習": "习",
    "語": "语",
    "書": "书",
    "說": "说",
    "話": "话",
    "時": "时",
    "間": "间",
    "東": "东",
    "車": "车",
    "長": "长",
    "門": "门",
    "開": "开",
    "關": "关",
    "電": "电",
    "腦": "脑",
    "網": "网",
    "龍": "龙",
    "愛": "爱",
    "見": "见",
    "覺": "觉",
    "讀": "读",
    "寫": "写",
    "聽": "听",
    "買": "买",
    "賣": "卖",
    "點": "点",
    "線": "线",
    "會": "会",
    "員": "员",
    "機": "机",
    "動": "动",
    "體": "体",
    "麼": "么",
    "個": "个",
    "們": "们",
    "來": "来",
    "對": "对",
    "過": "过",
    "還": "还",
    "進": "进",
    "這": "这",
    "裡": "里",
    "後": "后",
    "從": "从",
    "為": "为",
    "發": "发",
    "問": "问",
    "題": "题",
    "歲": "岁",
}


def read_zh_table(text: str) -> dict[str, str]:
    """A table of lines 'traditional<TAB>simplified[ simplified ...]'; the first form counts, and single characters only."""
    rows = (line.split("\t") for line in text.splitlines() if line.strip() and not line.startswith("#"))
    return {r[0]: r[1].split()[0] for r in rows if len(r) > 1 and len(r[0]) == 1 and r[1].split() and len(r[1].split()[0]) == 1}


def lemma_map(language: Language, target: Locale) -> dict[str, str]:
    """Whole-lemma replacements for an English dictionary; none for its own variant."""
    if target is Locale.US and language is Language.ENGLISH_GB:
        return SPELLINGS
    if target is Locale.GB and language is Language.ENGLISH_US:
        return {us: gb for gb, us in SPELLINGS.items()}
    return {}


def lemma_expression(lemma: Column, language: Language, target: Locale, zh_table: dict[str, str] | None = None) -> Column:
    """The lemma in the spelling of ``target``; anything but English to the other variant and Chinese to CN stays."""
    if language in (Language.CHINESE_TW, Language.CHINESE_HK) and target is Locale.CN:
        table = SIMPLIFIED if zh_table is None else zh_table
        return F.translate(lemma, "".join(table), "".join(table.values()))
    pairs = lemma_map(language, target)
    if not pairs:
        return lemma
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(table, lemma), lemma)
