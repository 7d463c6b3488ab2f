"""Problem 4: link the spellings of one person or organisation.

Suffix blocking. Names are parsed into forms, so that what differs in case, order, title, middle
initial or legal form only is one form already. Each token of a person's name is indexed under the shortest of its
suffixes, and of its reversal's, that is rare enough; a token that is too common even as a whole is
refined with the name's other tokens, and so becomes rare, before anything would be discarded. Blocks
are thus of bounded size. Pairs within a block are compared by the ratio of the longest common
subsequence. A firm has one token, its core, and nothing to refine it with: distinct cores meet under
what is left of them without the letters that slips may concern, or under a piece that slips leave
whole if they are long, so every two cores that are one apart from slips meet, however many forms
share them; the kinds of their forms are then compared all with all. Full spellings are grouped first; short ones (nickname, initial, firm without its kind)
join a group only if it is the only one they fit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.llm.groups import connected_groups
from tessera.session import parallelism, written

MIN_SUFFIX = 3
BLOCK = 40
#: Letters from which a word may hold two slips; in a large set many shorter names lie two letters apart.
LONG_WORD = 12
#: Occurrences from which a share is told: two similar names are two rather than one and a slip if the rarer has at least this
#: many and a tenth of the other's, and so it stays in tables of any size, as slips keep their share.
ESTABLISHED = 5
#: Cores of at least this length meet by pieces instead of deletions; up to two letters more they do both.
LONG_CORE = 25
# Titles, legal forms, words for kinds of organisation and their short forms.
TITLES = frozenset("dr prof professor eng engineer ing director dir capt captain mr mrs ms miss sir dame rev hon ato judge col gen lt maj sgt mme mlle herr frau sr sra dott".split())
LEGAL = [tuple(x.split()) for x in ("public limited company|private limited company|limited liability company|share company|public company|p l c|g m b h|l l c|s a r l|s p a|s c|s a|b v|n v|a g|l t d|i n c|plc|gmbh|ltd|limited|inc|incorporated|llc|sarl|spa|sc|bv|nv|ag|kg|oy|ab|pty|pvt").split("|")]
KINDS = {
    "mfg": "manufacturing", "manuf": "manufacturing", "corp": "corporation", "univ": "university", "uni": "university", "dept": "department", "intl": "international", "int": "international",
    "med": "medical", "assoc": "association", "assn": "association", "ins": "insurance", "co": "company", "sav": "savings", "svgs": "savings", "bk": "bank", "bros": "brothers", "grp": "group", "gp": "group",
    "auth": "authority", "dev": "development", "devt": "development", "inst": "institute", "instn": "institution", "dist": "distribution", "distr": "distribution", "svcs": "services", "svc": "services", "serv": "services",
    "eng": "engineering", "engg": "engineering", "mfi": "microfinance institution", "log": "logistics", "tel": "telecom", "telco": "telecom", "trans": "transport", "pwr": "power", "wtr": "water", "ptnrs": "partners", "tech": "technology",
    "min": "ministry", "hosp": "hospital", "comm": "commission", "fdn": "foundation", "mgmt": "management", "natl": "national", "govt": "government", "org": "organisation", "sch": "school", "coll": "college", "lab": "laboratory", "res": "research",
}
KIND_WORDS = frozenset(w for full in KINDS.values() for w in full.split()) | frozenset(
    "agency airline airlines association bureau capital centre center chamber church clinic club construction consulting cooperative council court energy enterprise enterprises federation finance financial foods fund holding holdings hotel industries industry investment media micro mission motors museum network office petroleum pharmacy port railway society solutions station steel stores studio systems trading trust union works".split()
)
_FILL = frozenset("the of and de des du der die das for".split())
# Short names that no rule derives from the full one.
NICKNAMES = {
    "larry": "lawrence", "laurie": "lawrence", "mick": "michael", "mike": "michael", "chuck": "charles", "hattie": "harriet", "harry": "harriet henry harold", "rick": "richard", "dick": "richard", "yoni": "yohannes jonathan johannes", "beppe": "giuseppe",
    "ofe": "ophelia", "trish": "patricia", "izzy": "isabella isabel", "sue": "susan", "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "gus": "augustine gustav", "tony": "anthony", "stevie": "stephanie", "kit": "christopher katherine", "bill": "william", "billy": "william", "liam": "william",
    "nell": "penelope eleanor helen", "ned": "edward", "ted": "edward theodore", "teddy": "edward theodore", "neil": "cornelius", "pancho": "francisco", "paco": "francisco", "sasha": "alexander alexandra", "lupita": "guadalupe", "bob": "robert", "bobby": "robert", "jack": "john", "jim": "james", "peg": "margaret",
    "dolly": "dorothea dorothy", "dot": "dorothea dorothy", "zac": "zachary", "zak": "zachary", "roz": "rosalind", "rosie": "rosalind rose", "wilma": "wilhelmina", "billie": "wilhelmina", "minnie": "wilhelmina", "sandy": "alexander", "kate": "katherine", "katie": "katherine", "kitty": "katherine", "pip": "philippa philip", "pippa": "philippa", "vicky": "victoria", "tori": "victoria",
    "len": "leonard", "lenny": "leonard", "leo": "leonard leopold", "tom": "thomas", "tommy": "thomas", "quin": "quentin", "con": "cornelius conrad", "hans": "johannes", "austin": "augustine", "gwen": "guinevere", "rob": "robert", "dan": "daniel", "val": "valentina valerie", "theo": "theodore theodora", "nando": "fernando", "pepe": "joseph", "jock": "john", "ron": "aaron ronald", "gerry": "gerald", "lottie": "charlotte", "lulu": "lucy louise", "mandy": "amanda", "mel": "melanie", "nora": "eleanor honora", "tina": "christina valentina", "trudy": "gertrude", "willa": "wilhelmina",
    "lou": "louis louise", "hank": "henry", "polly": "mary", "molly": "mary", "sally": "sarah", "nan": "anne", "jo": "josephine joseph joanna", "joe": "joseph", "peppe": "giuseppe", "pino": "giuseppe", "gigi": "giuseppe", "ike": "isaac", "bess": "elizabeth", "betty": "elizabeth", "libby": "elizabeth", "lisa": "elizabeth", "liz": "elizabeth", "beth": "elizabeth bethany", "buck": "william", "wally": "walter", "wat": "walter", "jenny": "jennifer jane", "tim": "timothy", "frank": "francisco francis", "fran": "francisco frances", "flossie": "florence", "lexi": "alexander alexandra", "alec": "alexander", "xander": "alexander", "drew": "andrew",
}


def _fold(text: str) -> str:
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return "".join(c for c in folded if unicodedata.category(c) not in ("Mn", "Me", "Cf"))


@lru_cache(maxsize=100_000)
def _kind(token: str) -> str | None:
    """The full word if the token names a kind of organisation, slips allowed."""
    if token in KIND_WORDS:
        return token
    if token in KINDS:
        return KINDS[token]
    if len(token) >= 6:
        for word in KIND_WORDS:
            if len(word) >= 6 and alike(token, word, 1):
                return word
    return None


def parse_name(text: str) -> tuple[str, list[str], str] | None:
    """(class, tokens, kind) of a name: a ``person`` of two or more tokens, a ``firm`` of one; None for things.

    A thing has a figure in its name, or no letters. Titles, legal forms, middle initials, articles and
    the order of tokens do not count.
    """
    tokens = re.findall(r"[^\W_]+", _fold(text).replace("&", " and ").replace("'", ""))
    if not tokens or any(c.isdigit() for t in tokens for c in t):
        return None
    legal = False
    changed = True
    while changed:
        changed = False
        for form in LEGAL:
            if len(tokens) > len(form) and tuple(tokens[-len(form) :]) == form:
                tokens, legal, changed = tokens[: -len(form)], True, True
    rest = tokens[1:] if tokens[0] in TITLES and len(tokens) > 2 else tokens
    kinds = [_kind(t) for t in rest]
    if legal or any(kinds) or tokens[0] == "the" or len([t for t in tokens if t not in TITLES]) == 1:
        core = [t for t, k in zip(rest, kinds) if not k and t not in _FILL]
        kind = " ".join(sorted(w for k in kinds if k for w in k.split()))
        if not core:
            return None
        return "firm", ["".join(core)], kind
    names = [t for t in rest if t not in TITLES] or rest
    full = [t for t in names if len(t) > 1]
    if len(full) >= 2:
        return "person", full if len(full) > 2 else sorted(full), ""
    initials = [t for t in names if len(t) == 1]
    if len(full) == 1 and initials:
        return "person", [initials[0], full[0]], ""
    return None


@lru_cache(maxsize=200_000)
def _subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        at = row & masks.get(c, 0)
        row = (row + at | row - at) & full
    return (full & ~row).bit_count()


def lcs_ratio(a: str, b: str) -> float:
    return 2 * _subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def alike(a: str, b: str, slips: int) -> bool:
    """The ratio of the longest common subsequence is what ``slips`` wrong letters in words of this length leave."""
    longest = max(len(a), len(b))
    return abs(len(a) - len(b)) <= slips and lcs_ratio(a, b) >= 1 - slips / longest - 1e-9


def same_spelling(a: str, b: str) -> bool:
    """One word typed twice, by the ratio of the longest common subsequence: one slip, or two in a long word."""
    if a == b:
        return True
    shorter = min(len(a), len(b))
    return shorter >= 4 and alike(a, b, 1 if shorter < LONG_WORD else 2)


@lru_cache(maxsize=100_000)
def is_nickname(short: str, full: str) -> bool:
    """``short`` may stand for the first name ``full``."""
    if len(short) < 2 or len(short) > len(full) or short == full:
        return False
    if full in NICKNAMES.get(short, "").split():
        return True
    stem = re.sub(r"(?:ie|ey|y|i|e|o|a)$", "", short) if len(short) > 3 else short
    stem = re.sub(r"(.)\1$", r"\1", stem)
    for s in {short, stem, stem.replace("ck", "c"), stem.replace("k", "c")}:
        if len(s) >= 2 and full.startswith(s) and len(full) > len(s):
            return True
        if len(s) >= 3 and s in full and len(full) - len(s) >= 2:
            return True
    return False


def _readings(tokens: list[str]) -> list[tuple[str, str]]:
    """(first name, surname) readings of a person's tokens; a surname may be typed as two words."""
    if len(tokens) == 2:
        a, b = tokens
        return [(a, b)] if len(a) == 1 else [(b, a)] if len(b) == 1 else [(a, b), (b, a)]
    return [(tokens[0], "".join(tokens[1:])), (tokens[-1], "".join(tokens[:-1]))]


def _established(a: str, b: str, counts: dict[str, int]) -> bool:
    """Both spellings occur so often that neither is a slip of the other."""
    m, n = counts.get(a, 0), counts.get(b, 0)
    return a != b and min(m, n) >= ESTABLISHED and min(m, n) * 10 >= max(m, n)


def compare_people(a: list[str], b: list[str], counts: dict[str, int]) -> tuple[str, bool] | None:
    """("S" for the same name in full, "N" with a nickname, "I" with an initial; whether ``a`` is the fuller), None for another person."""
    best, fuller = None, True
    for g, s in _readings(a):
        for h, t in _readings(b):
            if len(s) < 4 or len(t) < 4 or not same_spelling(s, t) or _established(s, t, counts):
                continue
            if g == h:
                return ("S" if len(g) > 1 else "I"), True
            short, full = (g, h) if len(g) <= len(h) else (h, g)
            if len(short) == 1:
                found = "I" if full.startswith(short) and len(full) > 1 else None
            elif is_nickname(short, full):
                found = "N"
            elif len(short) >= 4 and alike(short, full, 2 if len(short) >= 7 else 1):
                found = None if s != t and min(len(s), len(t)) < 6 else "S"
                if _established(g, h, counts):
                    found = None
            else:
                found = None
            # a common token is a first name, not the surname of this reading
            if found in ("N", "I") and counts.get(s, 0) > max(20, 5 * counts.get(full, 0)):
                found = None
            if found and (best is None or "SNI".index(found) < "SNI".index(best)):
                best, fuller = found, full == g
    return (best, fuller) if best else None


def same_kind(a: str, b: str) -> bool:
    """Two kinds of organisation are the same, slips allowed; short forms are spelled out before."""
    return a == b or (min(len(a), len(b)) >= 6 and alike(a, b, 2))


def compare_firms(a: str, kind_a: str, b: str, kind_b: str) -> tuple[str, bool] | None:
    """("S" for the same firm, "B" if one is named without its kind; whether ``a`` is the fuller), None for another firm."""
    if not same_spelling(a, b) or len(a) < 3:
        return None
    return compare_kinds(kind_a, kind_b)


@lru_cache(maxsize=100_000)
def compare_kinds(kind_a: str, kind_b: str) -> tuple[str, bool] | None:
    """What :func:`compare_firms` finds for two firms of one core."""
    if kind_a == kind_b or (kind_a and kind_b and same_kind(kind_a, kind_b)):
        return "S", True
    x, y = set(kind_a.split()), set(kind_b.split())
    return ("B", y < x) if x < y or y < x else None


def slip_keys(core: str) -> set[int]:
    """Keys of which two cores that :func:`same_spelling` accepts share at least one."""
    n = len(core)
    left = {core}
    if 4 <= n <= LONG_CORE + 1:
        for _ in range(1 if n < LONG_WORD else 2):
            left |= {w[:i] + w[i + 1 :] for w in left for i in range(len(w))}
    keys = {f"d{w}" for w in left}
    if n >= LONG_CORE:
        # two slips touch at most four of five pieces, and shift the others by at most two letters
        for length in range(n - 2, n + 3):
            ends = [length * i // 5 for i in range(6)]
            for i in range(5):
                for start in range(max(ends[i] - 2, 0), ends[i] + 3):
                    piece = core[start : start + ends[i + 1] - ends[i]]
                    keys.add(f"s{length}/{i}/{piece}")
    return {xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass")) - (1 << 63) for k in keys}


_FORM = "class string, tokens array<string>, kind string"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            form = parse_name(text)
            if form:
                for c, x in zip(rows, (key, "|".join((form[0], " ".join(form[1]), form[2])), *form)):
                    c.append(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.list_(pa.string())), pa.array(rows[4], pa.string())],
            names=["id", "form", "class", "tokens", "kind"],
        )


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the persons' forms of each block; rows come sorted by key."""
    key, block = None, []
    out: tuple[list, list, list] = ([], [], [])

    def links(rows: list[tuple]) -> None:
        for i, (form, tokens, counts) in enumerate(rows):
            for other, their, counts2 in rows[:i]:
                if form == other:
                    continue
                found = compare_people(tokens, their, {**dict(zip(tokens, counts)), **dict(zip(their, counts2))})
                if found:
                    code, fuller = found
                    # the short form first; two full ones in the order of their text
                    ordered = (min(form, other), max(form, other)) if code == "S" else (other, form) if fuller else (form, other)
                    for c, x in zip(out, (*ordered, code)):
                        c.append(x)

    def batch_of() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["a", "b", "link"])
        for c in out:
            c.clear()
        return made

    for batch in batches:
        for k, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if k != key:
                links(block)
                key, block = k, []
            block.append(tuple(row))
        if len(out[0]) > 20_000:
            yield batch_of()
    links(block)
    yield batch_of()


def _rare_keys(tokens: DataFrame, floor: int, block: int) -> DataFrame:
    """(token, key): the shortest prefix and the shortest suffix of ``text`` (token, text, least, n) that at most ``block`` names share.

    Where even the whole text is shared by more, key is null.
    """
    length = F.length("text")
    lengths = F.sequence(F.least(F.greatest(F.col("least"), F.lit(floor)), length), length)
    ends = tokens.select("token", "text", "n", F.explode(lengths).alias("len")).select(
        "token", "text", "n", "len", F.explode(F.array(F.concat(F.lit("<"), F.expr("left(text, len)")), F.concat(F.lit(">"), F.expr("right(text, len)")))).alias("key")
    )
    sizes = ends.groupBy("key").agg(F.sum("n").alias("size"))
    kept = ends.join(sizes, "key").filter(F.col("size") <= block)
    return kept.groupBy("token", "text", F.substring("key", 1, 1).alias("way")).agg(F.min_by("key", "len").alias("key")).select("token", "text", "key")


def _core_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [sorted(slip_keys(core)) for core in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["core", "keys"])


def _same_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = [same_spelling(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield batch.filter(pa.array(same, pa.bool_()))


def _compare_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between firms (form, kind, other, other_kind) whose cores are the same."""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for form, kind, other, kind2 in zip(*(batch.column(i).to_pylist() for i in range(4))):
            found = compare_kinds(kind, kind2)
            if found:
                code, fuller = found
                ordered = (min(form, other), max(form, other)) if code == "S" else (other, form) if fuller else (form, other)
                for c, x in zip(out, (*ordered, code)):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["a", "b", "link"])


def firm_links(typed: DataFrame) -> DataFrame:
    """``(a, b, link)`` between the forms (form, class, tokens, kind) of firms: all that :func:`compare_firms` accepts."""
    parts = parallelism(typed.sparkSession)
    firms = written(typed.filter("class = 'firm' and length(tokens[0]) >= 3").select("form", F.col("tokens")[0].alias("core"), "kind"), "firms")
    cores = firms.select("core").distinct().repartition(parts)
    keys = written(cores.mapInArrow(_core_keys, "core string, keys array<long>").select("core", F.explode("keys").alias("key")), "cores")
    meet = keys.join(keys.select("key", F.col("core").alias("other_core")), "key").filter("core < other_core")
    near = meet.select("core", "other_core").distinct().repartition(parts).mapInArrow(_same_cores, "core string, other_core string")
    other = firms.select(F.col("form").alias("other"), F.col("core").alias("other_core"), F.col("kind").alias("other_kind"))
    alike = firms.join(near, "core").join(other, "other_core").select("form", "kind", "other", "other_kind")
    equal = firms.join(other, F.col("core") == F.col("other_core")).filter("form < other").select("form", "kind", "other", "other_kind")
    return alike.unionByName(equal).mapInArrow(_compare_forms, "a string, b string, link string")


def name_links(forms: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(a, b, link)`` between distinct forms (form, class, tokens, kind); of unequal ones ``a`` is the shorter."""
    spark = forms.sparkSession
    typed = forms.select("form", "class", "tokens", "kind")
    token = written(typed.select("form", "class", F.posexplode("tokens").alias("i", "token"), F.col("tokens")), "tokens")
    counts = written(token.groupBy("token").agg(F.count("*").alias("n")), "counts")
    token = token.filter("class = 'person'")
    # a surname typed as two words is indexed as one word as well
    joined = token.filter("size(tokens) > 2").select("form", F.explode(F.array(F.array_join(F.expr("slice(tokens, 2, size(tokens) - 1)"), ""), F.array_join(F.expr("slice(tokens, 1, size(tokens) - 1)"), ""))).alias("token")).distinct()
    indexed = written(token.filter(F.length("token") > 1).select("form", "token").unionByName(joined).distinct(), "indexed")
    words = indexed.groupBy("token").agg(F.count("*").alias("n")).select("token", F.col("token").alias("text"), F.lit(MIN_SUFFIX).alias("least"), "n")
    plain = written(_rare_keys(words, 1, block).select("token", "key"), "plain")
    direct = indexed.join(plain, "token").select("form", F.concat(F.lit("t"), F.col("key")).alias("key"))
    # too common tokens, refined with each other token of the name, read forwards and backwards
    common = indexed.join(plain.select("token").distinct(), "token", "left_anti")
    others = token.groupBy("form", F.col("token").alias("other")).agg(F.count("*").alias("times"))
    pairs = common.join(others, "form").filter("token != other or times > 1")
    pairs = pairs.select("form", "token", F.explode(F.array(F.concat_ws("|", "token", "other"), F.concat_ws("|", "token", F.reverse("other")))).alias("text"))
    composite = pairs.groupBy("text").agg(F.count("*").alias("n"), F.first("token").alias("t")).select(F.col("text").alias("token"), "text", (F.length("t") + 2).alias("least"), "n")
    ends = composite.select("text", "n", F.explode(F.sequence(F.least("least", F.length("text")), F.length("text"))).alias("len")).select("text", "n", "len", F.expr("left(text, len)").alias("key"))
    sizes = ends.groupBy("key").agg(F.sum("n").alias("size"))
    chosen = ends.join(sizes, "key").groupBy("text").agg(F.coalesce(F.min_by("key", F.when(F.col("size") <= block, F.col("len"))), F.max_by("key", "len")).alias("key"))
    refined = pairs.join(chosen, "text").select("form", F.concat(F.lit("r"), F.col("key")).alias("key"))
    keys = direct.unionByName(refined).distinct()
    alone = keys.groupBy("key").count().filter("count > 1").select("key")
    with_counts = token.join(counts, "token").groupBy("form").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("c")).select("form", F.expr("transform(c, x -> x.n)").alias("counts"))
    rows = keys.join(alone, "key").join(typed.select("form", "tokens").join(with_counts, "form"), "form")
    parts = parallelism(spark) * 2
    found = rows.select("key", "form", "tokens", "counts").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_compare_blocks, "a string, b string, link string")
    return found.unionByName(firm_links(typed)).distinct()


def _merge(links: DataFrame, groups: DataFrame, kinds: list[str]) -> DataFrame:
    """Groups after each short group joined the only fuller group it fits, through links of these kinds."""
    label = groups.select(F.col("member"), "group_id")
    edges = (
        links.filter(F.col("link").isin(*kinds))
        .join(label.select(F.col("member").alias("a"), F.col("group_id").alias("ga")), "a")
        .join(label.select(F.col("member").alias("b"), F.col("group_id").alias("gb")), "b")
        .filter("ga != gb")
    )
    edges = edges.select(F.col("ga").alias("short"), F.col("gb").alias("full")).distinct()
    only = edges.groupBy("short").agg(F.min("full").alias("full"), F.count("*").alias("n")).filter("n = 1")
    edges = written(only.select("short", "full"), "merges")
    top = connected_groups(edges, "short", "full").select(F.col("member").alias("group_id"), F.col("group_id").alias("top"))
    return written(groups.join(top, "group_id", "left").select("member", F.coalesce("top", "group_id").alias("group_id")), "merged")


def name_groups(names: DataFrame, id_column: str, name_column: str, block: int = BLOCK) -> DataFrame:
    """``(id, group_id)`` of every row that names a person or organisation.

    Null and blank names and names of things (with a figure) take no part. One that no other spells
    otherwise is a group of its own. Repeated rows keep one group.
    """
    texts = names.select(F.col(id_column).cast("string").alias("id"), F.col(name_column).alias("text")).filter("id is not null and text is not null")
    parsed = written(texts.mapInArrow(_parsed, f"id string, form string, {_FORM}"), "parsed")
    forms = parsed.groupBy("form").agg(F.first("class").alias("class"), F.first("tokens").alias("tokens"), F.first("kind").alias("kind"))
    forms = written(forms, "forms")
    links = written(name_links(forms, block), "links")
    strong = connected_groups(links.filter("link = 'S'"), "a", "b")
    groups = written(forms.select(F.col("form").alias("member")).join(strong, "member", "left").select("member", F.coalesce("group_id", "member").alias("group_id")), "strong")
    for _ in range(2):  # a nickname may be short for a longer nickname of the same name
        groups = _merge(links, groups, ["N"])
    groups = _merge(links, groups, ["I", "B"])
    return parsed.select("id", F.col("form").alias("member")).join(groups, "member").select("id", "group_id").distinct()


def same_names(names: DataFrame, id_column: str, name_column: str) -> DataFrame:
    """``(id_a, id_b)``, smaller id first: every two rows that name the same person or organisation."""
    groups = written(name_groups(names, id_column, name_column), "groups")
    many = groups.groupBy("group_id").count().filter("count > 1").select("group_id")
    some = groups.join(many, "group_id")
    a, b = some.select("group_id", F.col("id").alias("id_a")), some.select("group_id", F.col("id").alias("id_b"))
    return a.join(b, "group_id").filter("id_a < id_b").select("id_a", "id_b").distinct()
