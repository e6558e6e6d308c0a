"""License scans: ordered signature rules over normalised words.

A text becomes its words (A-Z lower-cased; everything but ASCII letters, digits and characters outside ASCII
separates) with two spaces between, one before and one after. A rule is a regular expression over such words:
one space in a pattern stands for the gap between words. A rule runs only on texts that hold all its keywords; the first
one, its gate, is searched for all rules at once.
Where one detection lies inside another of the same or a better priority, the inner one goes; of equal spans
the rule with the better priority, then the earlier one stays.

Only SQL functions are used and no row leaves its task: no shuffle, no Python.

Defined cases: a null text is an empty text; texts without words have no detections; repeated rows are judged each
alone; a null id stays null; other columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import id_text

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Before lower-casing, A-Z belong to words too.
_RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases; their detections are never suppressed.
BASE = [
    ("gpl", "gnu license", "gnu general public license"),
    ("apache", "apache license", "apache license"),
    ("cc-by", "cc", "cc by"),
    ("mit", "license mit", "mit license"),
]

_V = "(?: version| v)?"
_LICENSE = "licen[cs]e"
_UNDER = "(?: [^ ]+){0,3} under(?: the)?(?: terms of(?: the)?)?"
#: Verbs of "... under the X", X and its word.
VERBS = ("licensed", "released", "distributed", "available", "published", "provided", "relicensed", "sublicensed")
UNDER = [("apache", "apache"), ("mit", "mit"), ("bsd", "bsd")]

#: Identifiers that follow "SPDX-License-Identifier:".
SPDX = """
0BSD AFL-2.1 AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0
Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0
BUSL-1.1 bzip2-1.0.6 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0
CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0
EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FSFAP FTL GFDL-1.1-only GFDL-1.2-only GFDL-1.3-only GPL-1.0-only GPL-1.0-or-later
GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND ICU IJG Intel IPL-1.0 ISC JSON LGPL-2.0-only
LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LPL-1.02 LPPL-1.3c MIT MIT-0
MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NASA-1.3 NCSA NTP ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OLDAP-2.8
OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 RPL-1.5 Ruby SISSL Sleepycat
SSPL-1.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 XFree86-1.1 Zlib zlib-acknowledgement ZPL-2.0 ZPL-2.1
""".split()

#: Named licenses: label, keywords, pattern. Priority 1: a name with a version or a whole clause.
NAMED = [
    ("agpl-3.0", "affero", f"(?:gnu )?affero general public {_LICENSE}{_V} 3(?: 0)?"),
    ("agpl-1.0", "affero", f"affero general public {_LICENSE}{_V} 1(?: 0)?"),
    ("lgpl-2.0", "gnu library", f"gnu library general public {_LICENSE}{_V} 2(?: 0)?"),
    ("lgpl-2.1", "gnu lesser", f"gnu lesser general public {_LICENSE}{_V} 2 1"),
    ("lgpl-3.0", "gnu lesser", f"gnu lesser general public {_LICENSE}{_V} 3(?: 0)?"),
    ("gpl-1.0", "gnu", f"gnu general public {_LICENSE}{_V} 1(?: 0)?"),
    ("gpl-2.0", "gnu", f"gnu general public {_LICENSE}{_V} 2(?: 0)?"),
    ("gpl-3.0", "gnu", f"gnu general public {_LICENSE}{_V} 3(?: 0)?"),
    ("gpl-2.0-or-later", "gnu later", f"gnu general public {_LICENSE}{_V} 2(?: 0)?(?: of the license)? or(?: at your option)? any later version"),
    ("gpl-3.0-or-later", "gnu later", f"gnu general public {_LICENSE}{_V} 3(?: 0)?(?: of the license)? or(?: at your option)? any later version"),
    ("gpl-1.0-or-later", "gnu free software foundation", "gnu general public license as published by the free software foundation"),
    ("gpl-2.0", "gplv2", "gplv2(?: 0)?"),
    ("gpl-3.0", "gplv3", "gplv3(?: 0)?"),
    ("lgpl-2.1", "lgplv2", "lgplv2(?: 1)?"),
    ("lgpl-3.0", "lgplv3", "lgplv3"),
    ("agpl-3.0", "agplv3", "agplv3"),
    ("gfdl-1.1", "gnu documentation", f"gnu free documentation {_LICENSE}{_V} 1 1"),
    ("gfdl-1.2", "gnu documentation", f"gnu free documentation {_LICENSE}{_V} 1 2"),
    ("gfdl-1.3", "gnu documentation", f"gnu free documentation {_LICENSE}{_V} 1 3"),
    ("apache-1.0", "apache", f"apache(?: software)? {_LICENSE}{_V} 1 0"),
    ("apache-1.1", "apache", f"apache(?: software)? {_LICENSE}{_V} 1 1"),
    ("apache-2.0", "apache", f"apache(?: software)? {_LICENSE}{_V} 2(?: 0)?"),
    ("apache-2.0", "apache org licenses", "apache org licenses license 2 0"),
    ("mpl-1.0", "mozilla", f"mozilla public {_LICENSE}{_V} 1 0"),
    ("mpl-1.1", "mozilla", f"mozilla public {_LICENSE}{_V} 1 1"),
    ("mpl-2.0", "mozilla", f"mozilla public {_LICENSE}{_V} 2(?: 0)?"),
    ("mpl-2.0", "mozilla mpl", "mozilla org mpl 2 0"),
    ("epl-1.0", "eclipse", f"eclipse public {_LICENSE}{_V} 1(?: 0)?"),
    ("epl-2.0", "eclipse", f"eclipse public {_LICENSE}{_V} 2(?: 0)?"),
    ("edl-1.0", "eclipse", f"eclipse distribution {_LICENSE}{_V} 1 0"),
    ("cddl-1.0", "cddl", "cddl(?: version| v)? 1 0"),
    ("cddl-1.1", "cddl", "cddl(?: version| v)? 1 1"),
    ("cddl-1.0", "development distribution", f"common development and distribution {_LICENSE}{_V} 1 0"),
    ("cddl-1.1", "development distribution", f"common development and distribution {_LICENSE}{_V} 1 1"),
    ("cpl-1.0", "common public", f"common public {_LICENSE}{_V} 1 0"),
    ("cpal-1.0", "attribution common", f"common public attribution {_LICENSE}{_V} 1 0"),
    ("ipl-1.0", "ibm", f"ibm public {_LICENSE}{_V} 1 0"),
    ("eupl-1.1", "european", f"european union public {_LICENSE}{_V} 1 1"),
    ("eupl-1.2", "european", f"european union public {_LICENSE}{_V} 1 2"),
    ("artistic-1.0", "artistic", f"artistic {_LICENSE}{_V} 1 0"),
    ("artistic-2.0", "artistic", f"artistic {_LICENSE}{_V} 2(?: 0)?"),
    ("afl-2.1", "academic", f"academic free {_LICENSE}{_V} 2 1"),
    ("afl-3.0", "academic", f"academic free {_LICENSE}{_V} 3(?: 0)?"),
    ("osl-2.1", "software open", f"open software {_LICENSE}{_V} 2 1"),
    ("osl-3.0", "software open", f"open software {_LICENSE}{_V} 3(?: 0)?"),
    ("bsl-1.0", "boost", f"boost software {_LICENSE}{_V} 1(?: 0)?"),
    ("busl-1.1", "business", f"business source {_LICENSE}{_V} 1 1"),
    ("sspl-1.0", "server side", f"server side public {_LICENSE}{_V} 1(?: 0)?"),
    ("elastic-2.0", "elastic", f"elastic {_LICENSE}{_V} 2(?: 0)?"),
    ("ofl-1.0", "sil", f"sil open font {_LICENSE}{_V} 1 0"),
    ("ofl-1.1", "sil", f"sil open font {_LICENSE}{_V} 1 1"),
    ("odbl-1.0", "database open", f"open database {_LICENSE}{_V} 1 0"),
    ("odbl-1.0", "odbl", "odbl(?: version| v)? 1 0"),
    ("pddl-1.0", "domain dedication", f"public domain dedication and {_LICENSE}{_V} 1 0"),
    ("odc-by-1.0", "odc", "odc by(?: version| v)? 1 0"),
    ("cecill-2.1", "cecill", "cecill(?: free software license agreement)?(?: version| v)? 2 1"),
    ("mulanpsl-2.0", "mulan", f"mulan(?: permissive software| psl)? {_LICENSE}{_V} 2"),
    ("ms-pl", "microsoft", f"microsoft public {_LICENSE}"),
    ("ms-rl", "microsoft reciprocal", f"microsoft reciprocal {_LICENSE}"),
    ("ncsa", "illinois", f"university of illinois(?: ncsa)? open source {_LICENSE}"),
    ("php-3.01", "php", f"php {_LICENSE}{_V} 3 01"),
    ("php-3.0", "php", f"php {_LICENSE}{_V} 3 0"),
    ("python-2.0", "python", f"python(?: software foundation)? {_LICENSE}{_V} 2"),
    ("ecl-2.0", "educational", f"educational community {_LICENSE}{_V} 2 0"),
    ("efl-2.0", "eiffel", f"eiffel forum {_LICENSE}{_V} 2"),
    ("lppl-1.3c", "latex", f"latex project public {_LICENSE}{_V} 1 3c"),
    ("lpl-1.02", "lucent", f"lucent public {_LICENSE}{_V} 1 02"),
    ("upl-1.0", "universal permissive", f"universal permissive {_LICENSE}{_V} 1 0"),
    ("zpl-2.0", "zope", f"zope public {_LICENSE}{_V} 2 0"),
    ("zpl-2.1", "zope", f"zope public {_LICENSE}{_V} 2 1"),
    ("rpl-1.5", "reciprocal", f"reciprocal public {_LICENSE}{_V} 1 5"),
    ("apsl-2.0", "apple", f"apple public source {_LICENSE}{_V} 2 0"),
    ("bsd-2-clause", "bsd", f"(?:2|two) clause bsd(?: {_LICENSE})?"),
    ("bsd-2-clause", "bsd", f"bsd (?:2|two) clause(?: {_LICENSE})?"),
    ("bsd-3-clause", "bsd", f"(?:3|three) clause bsd(?: {_LICENSE})?"),
    ("bsd-3-clause", "bsd", f"bsd (?:3|three) clause(?: {_LICENSE})?"),
    ("bsd-4-clause", "bsd", f"(?:4|four) clause bsd(?: {_LICENSE})?"),
    ("bsd-4-clause", "bsd", f"bsd (?:4|four) clause(?: {_LICENSE})?"),
    ("bsd-3-clause", "bsd modified", f"(?:new|revised|modified) bsd(?: {_LICENSE})?"),
    ("bsd-2-clause", "bsd simplified", f"(?:simplified|freebsd) bsd(?: {_LICENSE})?"),
    ("bsd", "redistribution binary", "redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", "endorse", "neither the name(?: [^ ]+){1,12} may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising acknowledgement", "all advertising materials mentioning features(?: [^ ]+){1,8} acknowledgement"),
    ("mit", "permission granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial portions", "shall be included in all copies or substantial portions of the software"),
    ("isc", "permission distribute", "permission to use copy modify and or distribute this software for any purpose"),
    ("0bsd", "zero bsd", f"(?:0|zero) clause bsd(?: {_LICENSE})?"),
    ("zlib", "warranty software", "this software is provided as is without any express or implied warranty"),
    ("unlicense", "encumbered", "free and unencumbered software released into the public domain"),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "zero domain", "creative commons zero(?: v1 0)?(?: universal)?"),
    ("wtfpl", "wtfpl", "wtfpl(?: version| v)?(?: 2)?"),
    ("mit-0", "attribution mit", f"mit no attribution {_LICENSE}"),
]

#: Names without a version and short notices. Priority 2.
SHORT = [
    ("agpl", "affero", f"affero general public {_LICENSE}"),
    ("agpl", "agpl", "agpl"),
    ("lgpl", "lesser", f"lesser general public {_LICENSE}"),
    ("lgpl", "lgpl", "lgpl"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("gpl", "gnu", f"gnu public {_LICENSE}"),
    ("gfdl", "documentation", f"free documentation {_LICENSE}"),
    ("apache", "apache", f"apache(?: software)? {_LICENSE}"),
    ("mit", "license mit", "mit(?: open source)? license"),
    ("mit", "licence mit", "mit(?: open source)? licence"),
    ("mit", "expat", f"expat {_LICENSE}"),
    ("mit", "x11", f"x11 {_LICENSE}"),
    ("isc", "isc", f"isc {_LICENSE}"),
    ("bsd", "bsd", f"bsd(?: style)? {_LICENSE}"),
    ("mpl", "mozilla", f"mozilla public {_LICENSE}"),
    ("epl", "eclipse", f"eclipse public {_LICENSE}"),
    ("cddl", "cddl", "cddl"),
    ("cpl", "common public", f"common public {_LICENSE}"),
    ("eupl", "eupl", "eupl"),
    ("artistic", "artistic", f"artistic {_LICENSE}"),
    ("afl", "academic", f"academic free {_LICENSE}"),
    ("osl", "software open", f"open software {_LICENSE}"),
    ("bsl", "boost", f"boost software {_LICENSE}"),
    ("busl", "business", f"business source {_LICENSE}"),
    ("sspl", "sspl", "sspl"),
    ("ofl", "font open", f"open font {_LICENSE}"),
    ("odbl", "database open", f"open database {_LICENSE}"),
    ("zlib", "zlib", f"zlib(?: libpng)? {_LICENSE}"),
    ("psf", "python", f"python(?: software foundation)? {_LICENSE}"),
    ("php", "php", f"php {_LICENSE}"),
    ("ruby", "ruby", f"ruby {_LICENSE}"),
    ("postgresql", "postgresql", f"postgresql {_LICENSE}"),
    ("openssl", "openssl", f"openssl {_LICENSE}"),
    ("vim", "vim", f"vim {_LICENSE}"),
    ("w3c", "w3c", f"w3c(?: software)?(?: notice and)? {_LICENSE}"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("public-domain", "dedicated domain", "dedicated to the public domain"),
    ("public-domain", "released domain", "released (?:in|into|to) the public domain"),
    ("public-domain", "domain public", "(?:is|are) in the public domain"),
    ("beerware", "beer", f"beer ware {_LICENSE}"),
    ("json", "evil", "shall be used for good not evil"),
    ("cecill", "cecill", "cecill"),
    ("proprietary", "proprietary confidential", "proprietary and confidential"),
    ("commercial", "license commercial", "commercial license(?: agreement)?"),
    ("eula", "agreement license", "end user license agreement"),
    ("cc", "creative commons", "creative commons"),
]

#: Hints that some terms hold, without naming them. Priority 3.
HINTS = [
    ("unknown-license-reference", "licensed", "licensed under(?: the)?(?: terms)?"),
    ("unknown-license-reference", "license", "see(?: the)? license(?: file)?(?: for)?"),
    ("unknown-license-reference", "license", "license file"),
    ("unknown-license-reference", "licensed", "this (?:work|software|file|document) is licensed"),
    ("open-source", "software open source", "open source software"),
    ("all-rights-reserved", "rights reserved", "all rights reserved"),
    ("copyright", "copyright", "copyright(?: c)? [12][0-9][0-9][0-9]"),
]

_CC_TERMS = {"nc": "(?:non commercial|noncommercial|nc)", "nd": "(?:no derivatives|noderivatives|no derivs|nd)", "sa": "(?:share alike|sharealike|sa)"}
_CONFIDENCE = (1.0, 0.95, 0.7, 0.3)


def _cc_rules() -> list[tuple[str, str, str, int]]:
    """Creative Commons terms with and without a version, as code, as words and as address."""
    rules = []
    for terms in ((), ("nc",), ("nd",), ("sa",), ("nc", "nd"), ("nc", "sa")):
        code = "-".join(("cc-by", *terms))
        tail = "".join(f" {_CC_TERMS[t]}" for t in terms)
        rules.append((code, "cc", "cc by" + "".join(f" {t}" for t in terms), 2))
        rules.append((code, "creative attribution", f"creative commons attribution{tail}", 2))
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"{code}-{version.replace(' ', '.')}"
            rules.append((label, "cc", "cc by" + "".join(f" {t}" for t in terms) + f" {version}", 1))
            rules.append((label, "creative attribution", f"creative commons attribution{tail}(?: [^ ]+){{0,3}} {version}", 1))
            rules.append((label, "creativecommons licenses", "creativecommons org licenses by" + "".join(f" {t}" for t in terms) + f" {version}", 1))
    return rules


def rules() -> list[dict]:
    """All signature rules, best first: number, label, keywords, pattern, priority, confidence, base."""
    found = [(*rule, 2, True) for rule in BASE]
    for name in SPDX:
        words = " ".join(re.findall("[a-z0-9]+", name.lower()))
        found.append((name.lower(), "spdx identifier", f"spdx license identifier {words}", 0, False))
    found += [(*rule, 1, False) for rule in NAMED]
    found += [(*rule, False) for rule in _cc_rules()]
    found += [(*rule, 2, False) for rule in SHORT]
    found += [(label, f"{verb} {word}", f"{verb}{_UNDER} {word}", 2, False) for label, word in UNDER for verb in VERBS]
    found += [(*rule, 3, False) for rule in HINTS]
    return [
        {"number": i, "label": label, "words": keywords.split(), "pattern": " " + pattern.replace(" ", "  ") + " ",
         "priority": priority, "confidence": _CONFIDENCE[priority], "base": base}
        for i, (label, keywords, pattern, priority, base) in enumerate(found)
    ]


def gate_words(table: list[dict]) -> list[str]:
    return sorted({rule["words"][0] for rule in table})


def gate_pattern(table: list[dict]) -> str:
    """Any gate as a word in either case; a look at the first three letters turns most words away."""
    words = gate_words(table)
    first = ["".join(sorted({c for w in words for c in ((w + " ")[i].lower(), (w + " ")[i].upper())})) for i in range(3)]
    return " (?=" + "".join(f"[{f}]" for f in first) + ")(?i:" + "|".join(words) + ") "


def _rule_array(table: list[dict]) -> Column:
    """The rules as one literal array, which the optimizer folds before any row is read."""
    quote = lambda s: "r'" + s + "'"
    return F.expr("array(" + ",".join(
        f"named_struct('number', {r['number']}, 'label', '{r['label']}', 'words', array({', '.join(map(quote, r['words']))}), "
        f"'pattern', {quote(r['pattern'])}, 'priority', {r['priority']}, 'confidence', {r['confidence']}D, 'base', {r['base']})"
        for r in table) + ")")


def _gaps(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(norm: Column, rule: Column) -> Column:
    """The detections of one rule: word positions from the spaces before and in each match."""
    found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    before = F.transform(F.split(norm, rule["pattern"], -1), lambda piece: _gaps(piece))
    pairs = F.zip_with(found, before, lambda m, gap: F.struct(gap.alias("gap"), _gaps(m).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(done: Column, one: Column) -> Column:
        at = done["at"] + one["gap"]
        end = at + one["own"]
        span = F.struct((at / 2).cast("int").alias("start"), (end / 2).cast("int").alias("end"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

    spans = F.aggregate(F.filter(pairs, lambda p: p["own"].isNotNull()), start, step, lambda done: done["out"])
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), rule["priority"].alias("priority"),
        rule["number"].alias("number"), rule["label"].alias("label"), rule["confidence"].alias("confidence"),
        rule["base"].alias("base")))


def _keep(found: Column) -> Column:
    """Drop detections that lie in an earlier one (in order of start, longest first) of no worse priority.

    ``reach`` holds, by priority, the furthest end of that or a better priority so far.
    """
    kind = "array<struct<start:int,back:int,priority:int,number:int,label:string,confidence:double,base:boolean>>"
    start = F.struct(F.array(*[F.lit(-1)] * len(_CONFIDENCE)).alias("reach"), F.array().cast(kind).alias("out"))

    def step(done: Column, d: Column) -> Column:
        inside = F.element_at(done["reach"], d["priority"] + 1) >= -d["back"]
        reach = F.transform(done["reach"], lambda far, p: F.when(p >= d["priority"], F.greatest(far, -d["back"])).otherwise(far))
        return F.struct(reach.alias("reach"), F.when(inside, done["out"]).otherwise(F.concat(done["out"], F.array(d))).alias("out"))

    return F.aggregate(found, start, step, lambda done: done["out"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, ``base`` (all places of base phrases) and ``detections`` (rule, label, word span) per row."""
    table = rules()
    spaced = F.trim(F.regexp_replace("text", _RAW_SEPARATORS, "  "))
    gated = id_text(docs, id_col, text_col).select("doc_id", F.concat(F.lit(" "), spaced, F.lit(" ")).alias("raw"))
    words = gated.select(
        "doc_id", F.when(F.col("raw") == "  ", 0).otherwise(_gaps(F.col("raw")) / 2).cast("long").alias("n_words"),
        F.when(F.col("raw").rlike(gate_pattern(table)), F.translate("raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        .otherwise("").alias("norm"))
    hits = words.select("doc_id", "n_words", "norm", F.array_intersect(
        F.split("norm", " "), F.expr("array(" + ",".join(f"'{w}'" for w in gate_words(table)) + ")")).alias("hits"))
    passed = F.filter(_rule_array(table), lambda r: F.array_contains(F.col("hits"), r["words"][0]) & F.forall(
        r["words"], lambda w: F.contains(F.col("norm"), F.concat(F.lit(" "), w, F.lit(" ")))))
    found = hits.select("doc_id", "n_words", F.when(F.size("hits") > 0, F.array_sort(F.flatten(F.transform(passed, lambda r: _places(F.col("norm"), r)))))
                        .otherwise(F.array()).alias("found"))
    return found.select(
        "doc_id", "n_words", F.filter("found", lambda d: d["base"]).alias("base"),
        F.transform(_keep(F.col("found")), lambda d: F.struct(
            d["label"].alias("label"), d["number"].alias("rule"), d["priority"].alias("priority"),
            d["confidence"].alias("confidence"), d["start"].alias("start"), (-d["back"]).alias("end"))).alias("detections"))


def digest(scanned: DataFrame) -> DataFrame:
    """One row of figures per scanned row."""
    base = F.array_sort(F.array_distinct(F.col("base")["label"]))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base")["start"]).cast("long").alias("first_word"),
        F.array_max(F.col("base")["start"]).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.col("base")["label"], F.col("detections")["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.col("detections")["confidence"]), F.lit(0.0)).alias("score"))


def digest_sql() -> str:
    """The same figures in SQL: rules as a table, containment as an anti-join within a document."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(
        f"({r['number']}, {quote(r['label'])}, [{', '.join(quote(' ' + w + ' ') for w in r['words'])}], {quote(r['pattern'])}, "
        f"{r['priority']}, {r['confidence']}::DOUBLE, {r['base']})" for r in rules())
    gaps = lambda s: f"(length({s}) - length(replace({s}, ' ', '')))"
    return f"""
    WITH rules(number, label, words, pattern, priority, confidence, base) AS (VALUES {rows}),
    n AS (SELECT doc_id, row_number() OVER () AS row, ' ' || trim(regexp_replace(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '{SEPARATORS}', '  ', 'g')) || ' ' AS norm FROM documents),
    m AS (SELECT row, number, label, priority, confidence, base,
        regexp_extract_all(norm, pattern) AS found, string_split_regex(norm, pattern) AS pieces
      FROM n JOIN rules ON contains(norm, words[1]) AND contains(norm, words[-1])
        AND len(list_filter(words, lambda w: NOT contains(norm, w))) = 0),
    u AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
    p AS (SELECT row, number, label, priority, confidence, base,
        ((list_sum(list_transform(pieces[1:i], lambda x: {gaps('x')})) +
          coalesce(list_sum(list_transform(found[1:i - 1], lambda x: {gaps('x')})), 0)) // 2)::BIGINT AS first,
        ({gaps('found[i]')} // 2)::BIGINT AS size FROM u),
    kept AS (SELECT * FROM p AS d WHERE NOT EXISTS (SELECT 1 FROM p AS e WHERE e.row = d.row
        AND e.first <= d.first AND e.first + e.size >= d.first + d.size AND e.priority <= d.priority
        AND (e.size > d.size OR e.size = d.size AND (e.priority < d.priority OR e.priority = d.priority AND e.number < d.number)))),
    b AS (SELECT row, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p WHERE base GROUP BY row),
    l AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(confidence) AS score FROM
        (SELECT row, label, confidence FROM kept UNION ALL SELECT row, label, 0.0 FROM p WHERE base) GROUP BY row)
    SELECT doc_id, (CASE WHEN norm = '  ' THEN 0 ELSE {gaps('norm')} // 2 END)::BIGINT AS n_words,
      coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
    FROM n LEFT JOIN b USING (row) LEFT JOIN l USING (row)"""
