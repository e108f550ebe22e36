"""Cleaning of titles, artists and lines: noise, credits, echoes of the title, annotations, chords, tails.

All are expressions over whole texts or, in lambdas, over their lines; texts are made tidy (unicode.tidy) once, before they are
cut into lines.  Word lists are parameters; the defaults are those of the corpora this library was made for.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import stripped

DEVANAGARI = "\\x{0900}-\\x{097F}"
EDGE = "^[ ,\\-\u2013\u2014]+|[ ,\\-\u2013\u2014]+$"

# Names of roles and qualifiers before them in credit lines; a separator must follow.
ROLES = """lyrics? singers? songs? casts? actors? actress music composer composed composition compose director producer starring vocals? songwriter
lyricist arranger recordist mixing mastering master mix studio editor colorist credits choreographer cinematographer assistant poster
publicity digital partner management executive action story concept design dialogue edit version video audio thanks""".split()
QUALIFIERS = """asst assist assistant associate additional first second dance chief executive direction edit making original lyrical official many new old
music song video audio lyrics nepali unicode roman""".split()
SECTIONS = "verse chorus bridge intro outro hook pre-chorus interlude skit refrain post-chorus sample instrumental".split()
FOOTERS = ["download lyrics", "click here.*", "start timer.*", "watch on youtube.*", "you might also like.*", "embed", "read more", "translations", "romaniz(?:e|ed|ation)s?", "best headphones.*", "special thanks\\S.*", "(?:special )?thanks?(?: to)? ?:?", "desc(?:ription)? ?(?:of )?(?:video)?"]
# Words of sites and credits; two of them make a line metadata.
METADATA = """album artist artists assistant audio bell button buttons cast channel channels chords choreographer cinematographer click colorist comment
comments compose composed composer concept content copyright credit credits description digital director download downloads editor executive
facebook featuring film follow free genre genres headphones instagram latest link lyric lyricist lyrics management master mastering media mix
mixing movie music notification official online page performed playlist poster producer production publicity recording recordist released
remix report rights scene screen share singer singers song songs starring stream streaming studio subscribe teaser thanks trailer
translated translation version video videos visit vocal vocals watch website writer written youtube""".split()
# Function words that tell an English line from a romanized one.
ENGLISH = """a an the of to and or is are was were be been being am you i we they he she it with for on in at by from as my your his her our their that this
these those but not so do does did dont cant wont will would could should can may might must have has had me him them us what when where
who why how all no yes up down out off away here there now then tonight today tomorrow yesterday again still just only ever never always
sometimes maybe very too much more most""".split()
ROMANIZED = """ma malai mero timi timilai timro hamro hami hamilai afno aafno cha chha chhan chhu chhau chhaina ho hun hunchha huncha thiyo thie
thiyena ra pani lai ko ki ka le bata sanga bina jaba kahile kaha kina kasto kati sabai garna garchu garchhan garne bhayo bhae bhayena
hola ta na ni re yo tyo yesto jasto jhai jastai ek dui tin char panch sakyo sake sakena dinu dinchhu liyo lyau aayo aauchha gayo
janchha basyo baschha""".split()
ROMANIZED_WORDS = """ma malai mero timi timro hami hamro usko unko maya prem man mann mutu muto dil sathi sansar jindagi jeevan jiwan aankha akha
aakha mukh mayalu priya cha chha chhu chhan chan ho hoina huncha hunchha hola thiyo thiyena bhayo bhayena garchu garchha garnu garyo lagcha
lagchha ladcha aayo aaye aayeu gaye gayeu jane hera herna suna sunnu bhana bhannu dekhna dekhchu feri pheri tara pani sadhai kahile kaha
kina kasari dukha khusi khushi sapana sapan aasha asha mayako gita geet gana baja roshni ujyalo andhakar jharan himal nepal desh deshko janma
aatma bhagwan krishna rama shiva goreto bato ghar yaha tyaha aja bholi hijo""".split()
GENERIC_TITLES = """aama aamaa aafno maya timi ma mann man sathi saathi yaad prem sapana akash aakash sansar jindagi jiban kahani katha gita geet song
music instrumental hits best old new nepali sad love trap beat beats""".split()
TRANSLATORS = ["genius nepali translations", "genius romanizations", "genius translations"]
# What uploaders add to titles.
JUNK = ["[(\\[](?:official|lyric|audio|video|full|hd)[^)\\]]*[)\\]]", "official\\s+music\\s+video", "(?:lyrical|lyrics|music)\\s+video", "full\\s+song", "(?:new\\s+)?nepali\\s+(?:rap\\s+)?song", "prod\\.?\\s*by[^|]*", "\\bprod\\b[^|]*", "www\\.\\S+|https?://\\S+", "\\(\\s*\\d{4}\\s*\\)", "\\b(?:19|20)\\d{2}\\b", "\\b\\d{3,}p\\b|\\b\\dx\\d+\\b", "\\b(?:remix|cover|live)\\b", "\\b(?:free\\s+)?download\\b", "\\(\\d+\\)|\\[\\d+\\]"]


def _any(words: Iterable[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it's used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _set(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def match_form(line: Column) -> Column:
    """Lower case, punctuation as single blanks: the form in which lines are compared."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), f"(?U)[^\\w\\s{DEVANAGARI}]", " "), "(?U)\\s+", " "))


def clean_title(title: Column, ascii_words: bool = False) -> Column:
    """A tidy title without "lyrics of", what follows a lyrics or chords marker (if anything is left), and language suffixes.

    ``ascii_words``: words end where ASCII letters, digits and underscores do, as in SQL; else letters of all scripts belong to them.
    """
    before, after = ("(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])") if ascii_words else ("\\b", "\\b")
    of = f"(?iU)^\\s*lyrics?\\s+of\\s+(.+?)(?:\\s+(?:from|by|in){after}.*)?$"
    title = F.when(title.rlike(of), F.regexp_replace(F.regexp_extract(title, of, 1), EDGE, "")).otherwise(title)
    marker = f"(?iU)\\s*[(\\[/\\-\u2013\u2014,]*\\s*{before}(?:official\\s+)?(?:lyric\\s*video|lyrics?(?:\\s*(?:and|&|/|,)?\\s*(?:chords?|music|video))?|chords?){after}.*$"
    cut = F.regexp_replace(F.regexp_replace(title, marker, ""), EDGE, "")
    title = F.when(cut != "", cut).otherwise(title)
    return F.regexp_replace(F.regexp_replace(title, "(?iU)\\s*[(\\-\u2013\u2014,]*\\s*(?:romanized|nepali song|nepali lyrics)\\s*\\)?\\s*$", ""), EDGE, "")


def clean_artist(artist: Column) -> Column:
    return stripped(F.regexp_replace(artist, "(?U)\\s+", " "))


def title_variants(title: Column) -> Column:
    """Forms of a tidy title that lines may echo."""
    both = F.array(title, clean_title(title))
    shorter = [both] + [F.transform(both, lambda t, p=p: F.trim(F.regexp_replace(t, p, ""))) for p in ("(?i),?\\s*nepali song\\s*$", "\\([^)]*\\)", "\\s*-\\s*.*$")]
    forms = F.transform(F.flatten(F.array(*shorter)), match_form)
    return F.array_distinct(F.filter(F.concat(forms, F.transform(forms, lambda t: F.concat(t, F.lit(" lyrics")))), lambda t: ~t.isin("", " lyrics")))


def artist_variants(artist: Column) -> Column:
    """A tidy artist, and each of several that are joined, in lower case."""
    name = F.lower(clean_artist(artist))
    return F.array_distinct(F.concat(F.array(name), F.filter(F.transform(F.split(name, "\\s*(?:,|&|feat\\.?|ft\\.?|aka)\\s*"), lambda p: F.trim(p)), lambda p: p != "")))


def echoes_title(line: Column, variants: Column) -> Column:
    """Whether a line is a form of the title, begins with one, or is the beginning of one."""
    test = lambda form: F.exists(variants, lambda v: (form == v) | form.startswith(v) | (v.startswith(form) & (F.length(form) >= 4)))
    return _let(F.regexp_replace(match_form(line), " lyrics$", ""), test)


def metadata_words(line: Column, words: Iterable[str] = METADATA) -> Column:
    """The number of a line's tokens that are words of sites and credits."""
    return F.regexp_count(match_form(line), F.lit(f"(?:^| ){_any(words)}(?= |$)"))


def english_prose(line: Column, forms: Iterable[str], least: int = 6, share: float = 0.7) -> Column:
    """Whether a line's words in Devanagari are mostly English ones in that script."""
    known = _set(forms) if forms else F.array().cast("array<string>")
    tokens = F.filter(F.split(line, "(?U)\\s+"), lambda t: t != "")
    ours = F.filter(tokens, lambda t: t.rlike(f"[{DEVANAGARI}]"))
    hits = F.size(F.filter(ours, lambda t: F.array_contains(known, match_form(t))))
    return (F.size(tokens) >= least) & (hits >= least) & (hits >= share * F.size(ours))


def noise_families(line: Column) -> list[tuple[str, Column]]:
    """Named tests of a stripped line that need nothing but itself."""
    role, qualifier = _any(ROLES), _any(QUALIFIERS)
    return [
        ("contributors", line.rlike("(?i)^\\d+\\s+contributors?$")),
        ("section", line.rlike(f"(?i)^\\[[^\\]]+\\]\\s*$|^{_any(SECTIONS)}\\b[^\\[]*$")),
        ("footer", line.rlike(f"(?i)^{_any(FOOTERS)}$|^see .+ on \\S+$")),
        ("credit", line.rlike(f"(?i)^[\\s\\-\u2013\u2014\u25ba\u25b6\u2022*\u00b7]*(?:{qualifier}\\s*\\.?\\s*[/|]?\\s*)?{role}\\s*[/|:\uff1a\\-\u2013]|^{_any(['singers?', 'starring', 'casts?', 'actors?', 'actress'])}\\s+\\S|^{_any(['singers?', 'casts?', 'actors?', 'music', 'lyrics?', 'starring'])}$")),
        ("hashtags", line.rlike("^#(?!\\s)\\S+(?:\\s+#\\S+)*$")),
        ("metadata", metadata_words(line) >= 2),
    ]


def is_noise(line: Column, titles: Column, artists: Column, artist: Column, templates: Iterable[str] = (), english_forms: Iterable[str] = ()) -> Column:
    """Whether a line is of a site, of credits, or an echo of the title or the artist, not of the text."""
    return _let(stripped(line), lambda x: _let(match_form(x), lambda form: _noise(x, form, titles, artists, artist, templates, english_forms)))


def _noise(line: Column, form: Column, titles: Column, artists: Column, artist: Column, templates: Iterable[str], english_forms: Iterable[str]) -> Column:
    noise = F.lit(False)
    for _, test in noise_families(line):
        noise = noise | test
    noise = noise | echoes_title(line, titles) | F.array_contains(artists, form)
    if templates:
        noise = noise | form.isin(*templates)
    if english_forms:
        noise = noise | english_prose(line, english_forms)
    translator = F.lower(artist).rlike(_any(TRANSLATORS))
    parts = F.split(line, " - ", 2)
    halves = (F.size(parts) == 2) & (F.array_contains(titles, match_form(parts[0])) | F.array_contains(artists, match_form(F.get(parts, F.lit(1)))))
    return (line != "") & (noise | (translator & (halves | form.isin("translation", "translations"))))


def without_annotations(line: Column) -> Column:
    """A line without contributors, addresses, hashtags, notes, embed marks, video suffixes, remarks in Latin script and emoji."""
    for pattern, by in (
        ("(?i)^\\d+\\s*contributors?[^\\n]*?lyrics\\s*(?:\\[[^\\]]*\\])?", ""), ("(?i)https?://\\S+|www\\.\\S+", " "), (f"(?U)(?<![\\w{DEVANAGARI}])#(?!\\s)\\S+", " "), ("[\u266c\u266a\u2669\u266b]", " "),
        ("\\s*[(\\[]?[Ee]mbed[)\\]]?\\s*$", ""), ("(?i)\\s*[-\u2013\u2014|]+\\s*(?:official\\s+)?video\\s*(?:\\|.*)?$", ""), ("\\([^)]*[A-Za-z][^)]*\\)", ""),
        ("[\\x{1f300}-\\x{1faff}\\x{2600}-\\x{27bf}\\x{fe0f}\\x{2190}-\\x{21ff}\\x{2b00}-\\x{2bff}]", ""), ("(?U)\\s+", " "),
    ):
        line = F.regexp_replace(line, pattern, by)
    return stripped(line)


def without_quotes(line: Column) -> Column:
    """A tidy line without quotes around it or around parts of it."""
    line = F.regexp_replace(line, "^[\"']+|[\"']+$", "")
    line = F.replace(F.replace(line, F.lit('""'), F.lit('"')), F.lit("''"), F.lit("'"))
    return stripped(F.regexp_replace(F.regexp_replace(line, "\"\\s*([^\"]+?)\\s*\"", "$1"), "'\\s*([^']+?)\\s*'", "$1"))


def clean_lines(text: Column, titles: Column, artists: Column, artist: Column, templates: Iterable[str] = (), english_forms: Iterable[str] = ()) -> Column:
    """(line, action) of a tidy text's lines: action is null for lines that stay, else why and which one went.

    ``titles`` and ``artists`` are columns of title_variants and artist_variants.
    """
    noise = lambda x: is_noise(x, titles, artists, artist, templates, english_forms)

    def each(raw: Column) -> Column:
        inline = lambda line: F.struct(line.alias("line"), F.when((line != "") & (line != raw) & noise(line), F.concat(F.lit("removed_inline:"), F.substring(line, 1, 80))).alias("action"))
        gone = F.struct(F.lit("").alias("line"), F.concat(F.lit("removed_noise:"), F.substring(stripped(raw), 1, 80)).alias("action"))
        return F.when(noise(raw), gone).otherwise(_let(without_annotations(without_quotes(raw)), inline))

    return F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), each)


def body_of(rows: Column) -> Column:
    """The text that clean_lines leaves; it drops blank lines."""
    return F.array_join(F.transform(F.filter(rows, lambda r: r["action"].isNull() & (r["line"] != "")), lambda r: r["line"]), "\n")


def actions_of(rows: Column) -> Column:
    return F.transform(F.filter(rows, lambda r: r["action"].isNotNull()), lambda r: r["action"])


def collapse_blank(lines: Column) -> Column:
    """Lines without blank ones at both ends, and one blank line for several."""
    blank = lambda x: F.trim(x) == ""
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), (blank(x) & ((i == 0) | blank(F.coalesce(F.get(lines, i - 1), F.lit(""))))).alias("drop"))), lambda r: ~r["drop"])
    kept = F.transform(kept, lambda r: F.when(blank(r["x"]), F.lit("")).otherwise(r["x"]))
    return F.when((F.size(kept) > 0) & blank(F.element_at(kept, -1)), F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)


def romanized_score(text: Column) -> Column:
    """The number of words that are common ones in romanized texts."""
    known = _set(ROMANIZED_WORDS)
    return F.size(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z']+"), F.lit(0)), lambda t: F.array_contains(known, t)))


def accepted(text: Column, script: Column, least: int = 120, hits: int = 2) -> Column:
    """ok, too_short or script_rejected:<script> of a text."""
    good = script.isin("devanagari", "mixed") | ((script == "romanized") & (romanized_score(text) >= hits))
    return F.when(F.length(F.coalesce(text, F.lit(""))) < least, "too_short").when(good, "ok").otherwise(F.concat(F.lit("script_rejected:"), script))


def _latin_tokens(line: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(line)), "(?U)\\s+"), lambda t: t.rlike("^[a-z][a-z'\u2019]*$"))


def looks_english(line: Column) -> Column:
    """Four words or more, three of them English function words and none a romanized one."""
    english, ours = _set(ENGLISH), _set(ROMANIZED)
    tokens = _latin_tokens(line)
    return (F.size(tokens) >= 4) & (F.size(F.filter(tokens, lambda t: F.array_contains(english, t))) >= 3) & (F.size(F.array_intersect(tokens, ours)) == 0)


def native_ratio(text: Column) -> Column:
    """The share of lines of the native language among those that can be told; 1 where none can."""
    ours = _set(ROMANIZED)
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    kind = lambda x: F.when(x.rlike(f"[{DEVANAGARI}]"), 1).when(F.size(_latin_tokens(x)) < 4, 0).when(looks_english(x), -1).when(F.size(F.array_intersect(_latin_tokens(x), ours)) > 0, 1).otherwise(0)
    kinds = F.transform(lines, kind)
    native, told = F.size(F.filter(kinds, lambda k: k == 1)), F.size(F.filter(kinds, lambda k: k != 0))
    return F.when(told > 0, native / told).otherwise(F.lit(1.0))


def keeps_english(token: Column, words: Iterable[str]) -> Column:
    """Whether a token is a word of the lexicon or its plural, -ing or -ed form."""
    known = _set(words)
    has = lambda t: F.array_contains(known, t)
    t = F.lower(token)
    ing, ed = F.regexp_replace(t, "ing$", ""), F.regexp_replace(t, "ed$", "")
    doubled = ing.rlike("(.)\\1$") & has(F.regexp_replace(ing, ".$", ""))
    of_ing = t.endswith("ing") & (has(ing) | has(F.concat(ing, F.lit("e"))) | doubled)
    return has(t) | (t.endswith("s") & has(F.regexp_replace(t, "s$", ""))) | of_ing | (t.endswith("ed") & (has(ed) | has(F.concat(ed, F.lit("e")))))


def kept_english(tokens: Column, words: Iterable[str], tails: Iterable[str] = ("s", "t", "m", "re", "ve", "ll", "d")) -> Column:
    """keeps_english of each token of a line; a contraction's tail is kept after a kept token."""
    known = _set(tails)
    step = lambda acc, t: F.concat(acc, F.array(keeps_english(t, words) | (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(False)) & F.array_contains(known, F.lower(t)))))
    return F.aggregate(tokens, F.array().cast("array<boolean>"), step)


CHORD = "^[A-G](?:#|b)?(?:maj|min|m|dim|aug|sus|add)?\\d*(?:/[A-G](?:#|b)?)?$"


def is_chords(line: Column, tokens: int = 10, chars: int = 40) -> Column:
    """A short line of chord names only."""
    names = F.filter(F.transform(F.split(F.replace(line, F.lit("|"), F.lit(" ")), "\\s+"), lambda t: F.regexp_replace(t, "^[.,;|()\\[\\]]+|[.,;|()\\[\\]]+$", "")), lambda t: t != "")
    return (F.size(names) > 0) & (F.size(names) <= tokens) & (F.length(line) <= chars) & F.forall(names, lambda t: t.rlike(CHORD))


def without_chords(text: Column, markers: Iterable[str] = ("chords", "tab", "capo")) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rtrim(x))
    return F.trim(F.array_join(F.filter(lines, lambda x: (F.trim(x) != "") & ~is_chords(F.trim(x)) & ~F.lower(F.trim(x)).isin(*markers)), "\n"))


def without_tail(lines: Column, tail: str) -> Column:
    """Lines before the first one that the pattern finds."""
    hits = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(tail), i)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, F.slice(lines, F.lit(1), F.coalesce(F.get(hits, F.lit(0)), F.lit(0)))).otherwise(lines)


def after_last(lines: Column, marker: str) -> Column:
    """Lines behind the last one that the pattern finds; all of them without one."""
    last = F.coalesce(F.array_max(F.transform(lines, lambda x, i: F.when(x.rlike(marker), i))), F.lit(-1))
    return F.slice(lines, last + 2, F.greatest(F.size(lines) - last - 1, F.lit(0)))


def without_stamps(text: Column) -> Column:
    """Lyrics of a provider without time stamps, blank lines, and credits or translations in CJK scripts."""
    cjk = "[\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}]"
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, "^\\[\\d{1,2}:\\d{2}(?:\\.\\d{1,3})?\\]\\s?", "")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & (~x.rlike(cjk) | x.rlike(f"[{DEVANAGARI}]"))), "\n")


def without_junk(title: Column) -> Column:
    """The first part of an uploader's title, without what uploaders add."""
    title = F.split(F.coalesce(title, F.lit("")), "\\s*[|\uff5c]\\s*", 2)[0]
    for pattern in JUNK:
        title = F.regexp_replace(title, f"(?i){pattern}", " ")
    return F.trim(title)


def track_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(without_junk(text)), f"(?U)[^\\w{DEVANAGARI}]+", " "))


def track_key(artist: Column, title: Column) -> Column:
    return F.concat(track_form(artist), F.lit("|"), track_form(title))


def primary_artist(artist: Column) -> Column:
    """The first of several credited artists."""
    return F.trim(F.regexp_extract(F.trim(F.coalesce(artist, F.lit(""))), "(?i)^(.*?)(?:\\s+feat\\.?\\s+|\\s+ft\\.?\\s+|\\s+x\\s+|\\s*&|\\s*,|$)", 1))


def file_name_parts(name: Column) -> Column:
    """(artist, title) of an audio file's name: what stands before and behind the first dash between blanks."""
    stem = F.regexp_replace(F.regexp_replace(name, "^.*[/\\\\]", ""), "(?i)(?:\\.(?:mp3|m4a|ogg|wav|flac|opus|aac|3gpp|webm))+$", "")
    pattern = "^(.*?) [-\u2013\u2014] (.*\\S.*)$"
    return F.struct(F.when(stem.rlike(pattern), F.trim(F.regexp_extract(stem, pattern, 1))).otherwise("").alias("artist"), F.when(stem.rlike(pattern), F.trim(F.regexp_extract(stem, pattern, 2))).otherwise(F.trim(stem)).alias("title"))


def generic_title(title: Column) -> Column:
    form = track_form(title)
    return (F.size(F.filter(F.split(form, " "), lambda t: t != "")) < 2) | form.isin(*GENERIC_TITLES)


def match_bucket(title_score: Column, artist_score: Column, has_artist: Column, title: Column) -> Column:
    """strong, probable, weak or none."""
    alone = F.when((title_score >= 95) & ~generic_title(title), "strong").when(title_score >= 85, "probable").when(title_score >= 65, "weak").otherwise("none")
    both = F.when((title_score >= 90) & (artist_score >= 85), "strong").when((title_score >= 78) & (artist_score >= 75), "probable")
    return F.when(~has_artist, alone).otherwise(both.when((title_score >= 65) | (artist_score >= 90), "weak").otherwise("none"))


def lyric_verdict(best: Column, metadata: Column, native: Column) -> Column:
    return F.when((best >= 68) | (metadata >= 55), "lyrics_confirmed").when(native < 0.4, "new_lyrics_non_native").when((best >= 45) | (metadata >= 45), "lyrics_ambiguous_linked").otherwise("new_lyrics")


def verdict_without_match(bucket: Column, candidate: Column, lyrics: Column, tokens: Column) -> Column:
    """What is known of a track before its lyrics are compared; null if they have to be."""
    lines = F.size(F.filter(F.split(F.coalesce(lyrics, F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    none = F.when((bucket == "strong") & candidate.isNotNull(), "metadata_only").when(candidate.isNotNull(), "metadata_candidate").otherwise("no_lyrics")
    return F.when(lyrics.isNull(), none).when((lines < 3) | (tokens < 10), "new_lyrics_too_short")


def mood_band(label: Column, score: Column) -> Column:
    label = F.lower(label)
    return F.when(score <= -0.35, "melancholic").when(score >= 0.35, "upbeat").when(label.startswith("pos"), "warm").when(label.startswith("neg"), "reflective").otherwise("neutral")


def difficulty(words: Column) -> Column:
    n = F.size(F.filter(F.split(F.trim(F.coalesce(words, F.lit(""))), "\\s+"), lambda t: t != ""))
    return F.when(n <= 3, "easy").when(n <= 7, "medium").otherwise("hard")


def draft_issue(text: Column) -> Column:
    """unexpected_chars, no_devanagari or null."""
    return F.when(text.rlike(f"[^{DEVANAGARI}\\s0-9.,!?'\"()\\-\\x{{200c}}\\x{{200d}}]"), "unexpected_chars").when(~text.rlike(f"[{DEVANAGARI}]"), "no_devanagari")


def pair_form(roman: Column) -> Column:
    """A romanized word without stretched letters, dashes and brackets, in one spelling."""
    text = F.regexp_replace(F.lower(F.trim(roman)), "(.)\\1{2,}", "$1")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[\u2013\u2014-]+", " "), "\\(.*?\\)", ""), "\\s+", " ")
    for a, b in (("cha ", "chha "), (" ch ", " chh "), (" x", " chh"), ("sh", "s")):  # fixed values, in this order
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(text)


def pair_issues(roman: Column, native: Column) -> Column:
    """Names of what is wrong with a pair of a romanized and a native word."""
    bad = native.rlike("[A-Za-z]") | native.rlike("[\u091f\u0920\u0921\u0922\u0923][\u091a\u091b\u091c\u091d\u091e]") | native.endswith("\u094d")
    clusters = F.regexp_count(roman, F.lit("kh|gh|chh|ch|jh|\u1e6dh|\u1e0dh|ph|bh|[kgcj\u1e6dtdpbmnrlvs\u015b\u1e63h\u1e45\u00f1\u1e47]"))
    letters = F.regexp_count(native, F.lit("[\\x{0915}-\\x{0939}]"))
    return F.filter(F.array(F.when(bad, "invalid structure"), F.when(clusters != letters, "phonetic mismatch")), lambda x: x.isNotNull())


def label_line(pairs: Column) -> Column:
    """"joy 0.12 / sadness 0.30" of a map."""
    return F.array_join(F.transform(F.map_entries(pairs), lambda e: F.concat_ws(" ", e["key"], F.format_number(e["value"], 2))), " / ")


def plain_form(text: Column) -> Column:
    """A text without brackets and dashes, and with single blanks: formatting makes no difference."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[()\\[\\]{}\\-\u2013\u2014]", " "), "\\s+", " "))


def edge_stripped(token: Column) -> Column:
    """A lower-case token without punctuation at both ends."""
    return F.regexp_replace(F.lower(token), "(?U)^[^\\w\\x{0900}-\\x{097F}]+|[^\\w\\x{0900}-\\x{097F}]+$", "")
