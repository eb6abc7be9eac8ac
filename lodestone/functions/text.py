"""Text: normalizers, tokenizers as array expressions, and the match predicates of scan mode.

Everything is a Column expression inside one scan; positions are those of words.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import extensions

IN_WORD, NOT_IN_WORD = r"[a-z0-9_\p{L}\p{N}]", r"[^a-z0-9_\p{L}\p{N}]"
WORD = IN_WORD + "+"


# ---- normalizers ----------------------------------------------------------------------------------
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
_HIRA = "".join(chr(c) for c in range(0x3041, 0x3097))
_KATA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
_MARKED = "àáâãäåāçćčèéêëēìíîïīñńòóôõöøōùúûüūýÿžźżšśđðłß"
_PLAIN = "aaaaaaaccceeeeeiiiiinnooooooouuuuuyyzzzssddls"
_HYPHENS = "‐‑‒–—―−﹣－"
_PROLONGED = "ー—―─━ｰ〜"
_DOTS = "·ᐧ•∙⋅⸱・･"
_ITERATION = "々〻ゝヽゞヾ"
_SMALL, _LARGE = "ぁぃぅぇぉっゃゅょゎゕゖァィゥェォッャュョヮヵヶ", "あいうえおつやゆよわかけアイウエオツヤユヨワカケ"
_VOICED = "がぎぐげござじずぜぞだぢづでどばびぶべぼぱぴぷぺぽガギグゲゴザジズゼゾダヂヅデドバビブベボパピプペポヴ"
_UNVOICED = "かきくけこさしすせそたちつてとはひふへほはひふへほカキクケコサシスセソタチツテトハヒフヘホハヒフヘホウ"

# The spelling of kana in Latin letters (Hepburn and the usual variants), longest first when read.
ROMAJI = {
    "ア": "a", "イ": "i", "ウ": "u", "エ": "e", "オ": "o", "カ": "ka", "キ": "ki", "ク": "ku", "ケ": "ke", "コ": "ko", "サ": "sa", "シ": "shi", "ス": "su", "セ": "se", "ソ": "so",
    "タ": "ta", "チ": "chi", "ツ": "tsu", "テ": "te", "ト": "to", "ナ": "na", "ニ": "ni", "ヌ": "nu", "ネ": "ne", "ノ": "no", "ハ": "ha", "ヒ": "hi", "フ": "fu", "ヘ": "he", "ホ": "ho",
    "マ": "ma", "ミ": "mi", "ム": "mu", "メ": "me", "モ": "mo", "ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ラ": "ra", "リ": "ri", "ル": "ru", "レ": "re", "ロ": "ro", "ワ": "wa", "ヲ": "wo", "ン": "n",
    "ガ": "ga", "ギ": "gi", "グ": "gu", "ゲ": "ge", "ゴ": "go", "ザ": "za", "ジ": "ji", "ズ": "zu", "ゼ": "ze", "ゾ": "zo", "ダ": "da", "ヂ": "ji", "ヅ": "zu", "デ": "de", "ド": "do",
    "バ": "ba", "ビ": "bi", "ブ": "bu", "ベ": "be", "ボ": "bo", "パ": "pa", "ピ": "pi", "プ": "pu", "ペ": "pe", "ポ": "po", "ヴ": "vu", "ー": "-",
    "キャ": "kya", "キュ": "kyu", "キョ": "kyo", "シャ": "sha", "シュ": "shu", "ショ": "sho", "チャ": "cha", "チュ": "chu", "チョ": "cho", "ニャ": "nya", "ニュ": "nyu", "ニョ": "nyo",
    "ヒャ": "hya", "ヒュ": "hyu", "ヒョ": "hyo", "ミャ": "mya", "ミュ": "myu", "ミョ": "myo", "リャ": "rya", "リュ": "ryu", "リョ": "ryo", "ギャ": "gya", "ギュ": "gyu", "ギョ": "gyo",
    "ジャ": "ja", "ジュ": "ju", "ジョ": "jo", "ビャ": "bya", "ビュ": "byu", "ビョ": "byo", "ピャ": "pya", "ピュ": "pyu", "ピョ": "pyo", "ファ": "fa", "フィ": "fi", "フェ": "fe", "フォ": "fo",
}
_SPELLINGS = {"シ": ("si",), "チ": ("ti",), "ツ": ("tu",), "フ": ("hu",), "ジ": ("zi",), "シャ": ("sya",), "シュ": ("syu",), "ショ": ("syo",), "チャ": ("tya",), "チュ": ("tyu",), "チョ": ("tyo",), "ジャ": ("zya", "jya"), "ジュ": ("zyu", "jyu"), "ジョ": ("zyo", "jyo"), "ン": ("nn", "m")}
# What the katakana options unify, sound by sound.
_SOUNDS = {
    "unify_katakana_v_sounds": (("ヴァ", "バ"), ("ヴィ", "ビ"), ("ヴェ", "ベ"), ("ヴォ", "ボ"), ("ヴ", "ブ")), "unify_katakana_bu_sound": (("ヴァ", "ブ"), ("ヴィ", "ブ"), ("ヴェ", "ブ"), ("ヴォ", "ブ"), ("ヴ", "ブ")),
    "unify_katakana_gu_small_sounds": (("グァ", "ガ"), ("グィ", "ギ"), ("グェ", "ゲ"), ("グォ", "ゴ")), "unify_katakana_di_sound": (("ヂ", "ジ"),), "unify_katakana_wo_sound": (("ヲ", "オ"),),
    "unify_katakana_zu_small_sounds": (("ズァ", "ザ"), ("ズィ", "ジ"), ("ズェ", "ゼ"), ("ズォ", "ゾ")), "unify_katakana_du_sound": (("ヅ", "ズ"),), "unify_katakana_du_small_sounds": (("ヅァ", "ザ"), ("ヅィ", "ジ"), ("ヅェ", "ゼ"), ("ヅォ", "ゾ")),
}


def _half_width(x: Column) -> Column:
    """Full-width forms to ASCII; a text without any, which is told sooner, isn't rebuilt."""
    some = (F.char_length(x) != F.octet_length(x)) & x.rlike(f"[{_FULL[0]}-{_FULL[-2]}{_FULL[-1]}]")
    return F.when(some, F.translate(x, _FULL, _HALF)).otherwise(x)


def fold(text: str) -> str:
    """What normalize() makes of a literal: lower case, full-width forms to ASCII."""
    return text.translate(str.maketrans(_FULL, _HALF)).lower()


def nfkc(x: Column, form: str = "NFKC") -> Column:
    """Unicode's compatibility composition, by Arrow batches: Spark has no expression for it."""
    import pyarrow as pa

    @F.arrow_udf("string")
    def run(texts):
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    return run(x)


def _marks(x: Column) -> Column:
    """Latin letters without their marks."""
    marked = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1)
    return F.translate(x, marked, "".join(unicodedata.normalize("NFD", c)[0] for c in marked))


def _each(x: Column, pairs) -> Column:
    for a, b in sorted(pairs, key=lambda p: -len(p[0])):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _after_vowel(x: Column, mark: str) -> Column:
    """A prolonged sound mark, or a hyphen, behind kana as the vowel it prolongs."""
    for vowel, kana in zip("アイウエオン", ("アカサタナハマヤラワガザダバパァャヮ", "イキシチニヒミリギジヂビピィ", "ウクスツヌフムユルグズヅブプヴゥュ", "エケセテネヘメレゲゼデベペェ", "オコソトノホモヨロヲゴゾドボポォョ", "ン")):
        hira = kana.translate(str.maketrans(_KATA, _HIRA))
        x = F.regexp_replace(x, f"(?<=[{kana}])[{mark}]", vowel)
        x = F.regexp_replace(x, f"(?<=[{hira}])[{mark}]", vowel.translate(str.maketrans(_KATA, _HIRA)))
    return x


def normalize(x: Column, normalizer: str = "auto", **options) -> Column:
    """Lower case, full-width forms to ASCII; a name that begins with NormalizerNFKC composes all of Unicode.

    options as the normalizers name them: unify_* and remove_*, strip, each in the order below.
    """
    if normalizer in ("none", "", "NormalizerNone"):
        return x
    if own := extensions.find("normalizer", normalizer):
        return own(x, **options)
    if normalizer == "NormalizerHTML":
        x = normalize_html(x)
    x = F.lower(nfkc(x) if normalizer.startswith("NormalizerNFKC") else _half_width(x))
    on = lambda *names: any(options.get(n) for n in names)
    if on("unify_latin_alphabet_with"):
        x = _marks(x)
    if on("unify_alphabet", "remove_accents"):  # letters too that are no base with a mark
        x = F.translate(_marks(x), _MARKED, _PLAIN)
    if on("unify_iteration_mark"):
        x = F.regexp_replace(x, f"(.)[{_ITERATION}]", "$1$1")
    if on("unify_to_katakana"):
        for latin, kana in sorted(((r, k) for k, rs in {k: (v, *_SPELLINGS.get(k, ())) for k, v in ROMAJI.items()}.items() for r in rs if k not in ("ヂ", "ヅ", "ー", "ン")), key=lambda p: -len(p[0])):
            x = F.replace(x, F.lit(latin), F.lit(kana))
        x = F.replace(F.translate(x, _HIRA, _KATA), F.lit("n"), F.lit("ン"))
    if on("unify_kana"):
        x = F.translate(x, _KATA, _HIRA)
    if on("unify_kana_case"):
        x = F.translate(x, _SMALL, _LARGE)
    if on("unify_kana_voiced_sound_mark"):
        x = F.translate(x, _VOICED, _UNVOICED)
    for name, pairs in _SOUNDS.items():
        if on(name):
            x = _each(x, pairs)
    if on("unify_katakana_trailing_o"):
        x = F.regexp_replace(x, "(?<=[オコソトノホモヨロゴゾドボポォョ])オ", "ウ")
    if on("unify_hyphen_and_prolonged_sound_mark"):
        both = "".join(dict.fromkeys(_HYPHENS + _PROLONGED))
        x = F.translate(x, both, "-" * len(both))
    if on("unify_hyphen"):
        x = F.translate(x, _HYPHENS, "-" * len(_HYPHENS))
    if on("unify_prolonged_sound_mark"):
        x = F.translate(x, _PROLONGED, "ー" * len(_PROLONGED))
    if on("unify_kana_prolonged_sound_mark"):
        x = _after_vowel(x, "ー")
    if on("unify_kana_hyphen"):
        x = _after_vowel(x, "-")
    if on("unify_middle_dot"):
        x = F.translate(x, _DOTS, "·" * len(_DOTS))
    if on("unify_to_romaji"):
        x = F.translate(x, _HIRA, _KATA)
        x = F.regexp_replace(x, "ッ(?=[カキクケコ])", "k")
        for first, kana in (("s", "サシスセソ"), ("t", "タツテト"), ("t", "チ"), ("p", "パピプペポ"), ("g", "ガギグゲゴ"), ("b", "バビブベボ")):
            x = F.regexp_replace(x, f"ッ(?=[{kana}])", first)
        x = _each(F.regexp_replace(x, "ン(?=[アイウエオヤユヨ])", "n'"), ROMAJI.items())
    if on("remove_blank", "remove_blank_force"):
        x = F.regexp_replace(x, r"\s+", "")
    if on("remove_new_line"):
        x = F.regexp_replace(x, r"[\r\n]+", "")
    if on("remove_symbol"):
        x = F.regexp_replace(x, r"[\p{P}\p{S}]+", "")
    if on("strip"):
        x = F.trim(x)
    return x


def kana_pattern(query: str) -> str:
    """A pattern of katakana readings that begin as the query does, which is in Latin letters or kana."""
    text = fold(query).translate(str.maketrans(_HIRA, _KATA))
    spelled = sorted(((r, k) for k, v in ROMAJI.items() for r in (v, *_SPELLINGS.get(k, ()))), key=lambda p: -len(p[0]))
    out, at = "", 0
    while at < len(text):
        rest = text[at:]
        if not re.match("[a-z-]", rest):
            out, at = out + re.escape(rest[0]), at + 1
            continue
        if len(rest) > 1 and rest[0] == rest[1] and rest[0] not in "aiueon-":
            out, at = out + "ッ", at + 1
            continue
        length = next((len(r) for r, _ in spelled if rest.startswith(r) and not (r in ("n", "m") and len(rest) > 1 and rest[1] in "aiueoy")), 0)
        if length and not (rest == "n"):
            out, at = out + "(?:" + "|".join(sorted({re.escape(k) for r, k in spelled if r == rest[:length]})) + ")", at + length
            continue
        begun = sorted({k for r, k in spelled if r.startswith(rest)})  # a sound that isn't written out
        return out + ("(?:" + "|".join(map(re.escape, begun)) + "|ッ)" if begun else re.escape(rest))
    return out


def normalize_html(x: Column) -> Column:
    """The text of HTML: tags away, the five entities back."""
    return unescape_html(html_untag(x))


def html_untag(x: Column) -> Column:
    return F.regexp_replace(x, r"<[^>]*>", "")


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape_html(x: Column) -> Column:
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("&", "&amp;")):
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


# ---- tokenizers -----------------------------------------------------------------------------------
def ngrams(x: Column, n: int) -> Column:
    size = F.char_length(x)
    many = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(x, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(many)


def _bigram(x: Column, n: int, split_alpha=False, split_digit=False, split_symbol=False, ignore_blank=False) -> Column:
    """Runs of letters, of digits and of symbols stay whole unless they are split; other script goes in n-grams."""
    kinds = []
    if not split_alpha:
        kinds.append(r"[A-Za-z]+")
    if not split_digit:
        kinds.append(r"[0-9]+")
    if not split_symbol:
        kinds.append(r"[\p{P}\p{S}]+")
    x = F.regexp_replace(x, r"\s+", "") if ignore_blank else x
    whole = "|".join(kinds) or r"(?!)"
    rest = rf"(?:(?!{whole})\S)+"
    runs = F.regexp_extract_all(x, F.lit(f"((?:{whole})|{rest})"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^(?:{whole})$"), F.array(r)).otherwise(
        F.transform(F.sequence(F.lit(1), F.char_length(r)), lambda i: F.substr(r, i, F.lit(n))))))


def tokenize(x: Column, tokenizer: str = "TokenWord", normalizer: str = "auto", **options) -> Column:
    """The tokens of a text in order, by the tokenizer's name."""
    if own := extensions.find("tokenizer", tokenizer):
        return own(F.coalesce(x, F.lit("")), **options)
    x = F.coalesce(normalize(x, normalizer), F.lit(""))
    grams = {"TokenUnigram": 1, "TokenBigram": 2, "TokenTrigram": 3}
    m = re.fullmatch(r"TokenBigram(IgnoreBlank)?(SplitSymbol)?(Alpha)?(Digit)?", tokenizer)
    if tokenizer == "TokenWord":
        return F.regexp_extract_all(x, F.lit(f"({WORD})"), F.lit(1))
    if tokenizer in grams or m:
        return _bigram(x, grams.get(tokenizer, 2), bool(m and m[3]), bool(m and m[4]), bool(m and m[2]), bool(m and m[1]))
    if tokenizer == "TokenNgram":
        return ngrams(x, int(options.get("n", 2)))
    if tokenizer == "TokenRegexp":
        return ngrams(x, 2)
    if tokenizer == "TokenDelimit":
        return F.filter(F.split(x, options.get("pattern") or re.escape(options.get("delimiter", " "))), lambda t: t != "")
    if tokenizer == "TokenDelimitNull":
        return F.filter(F.split(x, "\\x00"), lambda t: t != "")
    if tokenizer == "TokenPattern":
        return F.regexp_extract_all(x, F.lit(f"({options['pattern']})"), F.lit(1))
    if tokenizer == "TokenTable":
        # Longest first, as a token table matches.
        return F.regexp_extract_all(x, F.lit("(" + "|".join(re.escape(k) for k in sorted(options["keys"], key=len, reverse=True)) + ")"), F.lit(1))
    raise ValueError(f"no tokenizer {tokenizer}")


TOKENIZERS = (
    "TokenDelimit", "TokenUnigram", "TokenBigram", "TokenTrigram", "TokenBigramSplitSymbol", "TokenBigramSplitSymbolAlpha", "TokenBigramSplitSymbolAlphaDigit",
    "TokenBigramIgnoreBlank", "TokenBigramIgnoreBlankSplitSymbol", "TokenBigramIgnoreBlankSplitSymbolAlpha", "TokenBigramIgnoreBlankSplitSymbolAlphaDigit",
    "TokenDelimitNull", "TokenRegexp", "TokenNgram", "TokenPattern", "TokenTable", "TokenWord",
)
NORMALIZERS = ("NormalizerAuto", "NormalizerNFKC", "NormalizerHTML", "NormalizerTable")


def stop_words(tokens: Column, words) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(list(words)))


def token_filter(tokens: Column, name: str, **options) -> Column:
    """What a token filter, by its name, makes of an array of tokens."""
    if own := extensions.find("token_filter", name):
        return own(tokens, **options)
    if name == "TokenFilterStopWord":
        return stop_words(tokens, options.get("words", ()))
    if name.startswith("TokenFilterNFKC"):
        return _each_token(tokens, name.replace("TokenFilter", "Normalizer"), options)
    if name == "TokenFilterStem":
        if options.get("algorithm", "english") not in ("english", "porter"):
            raise ValueError(f"no stemming of {options['algorithm']}")
        if options.get("keep_original"):
            return F.flatten(F.transform(tokens, lambda t: F.array_distinct(F.array(stem(t), t))))
        return F.transform(tokens, stem)
    raise ValueError(f"no token filter {name}")


def _each_token(tokens: Column, normalizer: str, options: dict) -> Column:
    """All tokens composed in one call, parted again, then the options for each."""
    joined = nfkc(F.array_join(tokens, "\x1f"))
    return F.filter(F.transform(F.split(joined, "\x1f"), lambda t: normalize(t, "auto", **options)), lambda t: t != "")


#: The longest suffixes of the second step of the usual English stemmer, and what stays.
_SUFFIXES = (("ational", "ate"), ("tional", "tion"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("biliti", "ble"), ("aliti", "al"), ("iviti", "ive"), ("entli", "ent"), ("ousli", "ous"), ("alli", "al"))


def stem(t: Column) -> Column:
    """English words without plural, -ed, -ing and a few longer endings, by expressions alone; others as they are."""
    plural = F.when(t.endswith("sses"), F.regexp_replace(t, "sses$", "ss")).when(t.rlike("[a-z]{2}ies$"), F.regexp_replace(t, "ies$", "i")).when(t.rlike("[^aeiou]*[aeiouy].*[^su]s$"), F.regexp_replace(t, "s$", "")).otherwise(t)
    cut = F.regexp_replace(plural, "^(.*[aeiouy].*?)(?:ingly|edly|ing|ed)$", "$1")
    again = F.when(cut == plural, cut).when(cut.rlike("(at|bl|iz)$"), F.concat(cut, F.lit("e"))).when(cut.rlike("([bdfgmnprt])\\1$"), F.regexp_replace(cut, ".$", "")).otherwise(cut)
    out = F.regexp_replace(again, "^(.*[aeiouy].*)y$", "$1i")
    for ending, short in _SUFFIXES:
        out = F.regexp_replace(out, f"^(.*[aeiouy][^aeiouy].*?){ending}$", f"$1{short}")
    return F.when(F.char_length(t) <= 2, t).otherwise(out)


def normalize_table(x: Column, table: dict[str, str]) -> Column:
    """Replace by a table, the longest keys first."""
    for k in sorted(table, key=lambda k: (-len(k), k)):
        x = F.replace(x, F.lit(k), F.lit(table[k]))
    return x


# ---- predicates -----------------------------------------------------------------------------------
def words_of(text: str) -> list[str]:
    return re.findall(r"\w+", fold(text))


def match(x: Column, text: str) -> Column:
    """The normalized text stands somewhere in x."""
    return F.contains(normalize(x), F.lit(fold(text)))


def occurrences(x: Column, text: str) -> Column:
    """How often the normalized text stands in x, without overlap: the term frequency of scan mode."""
    if not text:
        return F.lit(0)
    n = normalize(x)
    return F.floor((F.char_length(n) - F.char_length(F.replace(n, F.lit(fold(text)), F.lit("")))) / len(fold(text))).cast("int")


def let(x: Column, f) -> Column:
    """f(x) with x computed once for each row: what a lambda refers to is else computed again for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def places(tokens: Column, phrase: list[str]) -> Column:
    """Where the phrase's first word stands."""
    if len(phrase) == 1:
        return F.filter(F.transform(tokens, lambda t, i: F.when(t == phrase[0], i)), lambda p: p.isNotNull())
    want = F.array(*map(F.lit, phrase))

    def find(t):
        last = F.size(t) - len(phrase)
        first = F.filter(F.transform(t, lambda w, i: F.when(w == phrase[0], i)), lambda p: p.isNotNull())
        return F.filter(first, lambda i: (i <= last) & (F.slice(t, i + 1, F.lit(len(phrase))) == want))

    return let(tokens, find)


def near(tokens: Column, phrases: list[list[str]], most: int = 10, least: int | None = None, ordered: bool = False) -> Column:
    """Whether all phrases stand near each other: from the end of the first to the start of the last, in words."""
    if not phrases or not all(phrases):
        return F.lit(False)
    size = [len(p) for p in phrases]

    def close(starts):
        if len(starts) == 1:
            return F.lit(True)
        gap = F.greatest(*starts) - F.least(*[s + n for s, n in zip(starts, size)])
        ok = F.lit(True) if most < 0 else gap <= most
        if least is not None:
            ok = ok & (gap >= least)
        for a, b in zip(starts, starts[1:]) if ordered else ():
            ok = ok & (a < b)
        return ok

    def down(found, starts):
        k = len(starts)
        return close(starts) if k == len(phrases) else F.exists(F.get(found, F.lit(k)), lambda p: down(found, [*starts, p]))

    every = let(tokens, lambda t: F.array(*[places(t, p) for p in phrases]))
    return F.coalesce(let(every, lambda found: down(found, [])), F.lit(False))


def near_in(x: Column, choices: list[list[list[str]]], most: int = 10, least: int | None = None, ordered: bool = False) -> Column:
    """Whether all phrases of some choice stand near each other in a text, which is normalized once.

    A text that lacks a word that every choice has isn't tokenized.
    """
    if not choices:
        return F.lit(False)
    common = sorted(set.intersection(*[{w for p in c for w in p} for c in choices]), key=lambda w: (-len(w), w))

    def ask(n):
        there = reduce(lambda a, b: a & b, [F.contains(n, F.lit(w)) for w in common], n.isNotNull())
        found = let(tokenize(n, normalizer="none"), lambda t: reduce(lambda a, b: a | b, [near(t, c, most, least, ordered) for c in choices]))
        return F.when(there, found).otherwise(False)

    return let(normalize(x), ask)


def phrase(x: Column, words: list[str]) -> Column:
    """Whether the words stand one after another, told by one pattern without tokens."""
    first, *rest = (re.escape(fold(w)) for w in words)
    said = f"{first}(?<!{IN_WORD}{first})" + "".join(f"{NOT_IN_WORD}+{w}" for w in rest) + f"(?!{IN_WORD})"
    return F.coalesce(normalize(x).rlike(said), F.lit(False))


def product(text: str) -> list[list[list[str]]]:
    """'(abc bcd) (ef)' -> every choice of one phrase from each group."""
    groups = [g.split() for g in re.findall(r"\(([^)]*)\)", text)] or [[w] for w in text.split()]
    out: list[list[list[str]]] = [[]]
    for g in groups:
        out = [[*x, words_of(p)] for x in out for p in g]
    return out


def quorum(x: Column, words: list[str]) -> Column:
    """How many of the words stand in x."""
    total = F.lit(0)
    for w in words:
        total = total + match(x, w).cast("int")
    return total
