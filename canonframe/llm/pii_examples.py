"""Texts with planted personal data and look-alikes, to fit and calibrate the span classifier on.

Every row is made from its number by expressions: a value of some form is put into a sentence of some setting. Whether it is
personal data follows from the pair of form and setting alone; the classifier never sees either, only the text. The table
has `n` rows whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the table; a bound on all that is learned from it.
EXAMPLES = 6_000


def _d(k: int, n: int) -> str:
    return f"lpad(cast(pmod(xxhash64(id, {k}), {10**n}) AS string), {n}, '0')"


def _hex(k: int, n: int) -> str:
    return f"substr(sha2(concat(id, '-{k}'), 256), 1, {n})"


def _mixed(k: int, n: int) -> str:
    return f"substr(translate(base64(unhex(sha2(concat(id, '+{k}'), 512))), '+/=', 'xYz'), 1, {n})"


def _pick(k: int, *options: str) -> str:
    return f"element_at(array({', '.join(repr(o) for o in options)}), cast(pmod(xxhash64(id, {k}), {len(options)}) AS int) + 1)"


def _words(k: int, n: int, joint: str) -> str:
    one = lambda i: _pick(k + i, "main", "data", "user", "report", "index", "value", "first", "backup", "season", "local")
    return "concat_ws('" + joint + "', " + ", ".join(one(i) for i in range(n)) + ")"


_NAME = _pick(91, "anna", "li.wei", "omar", "j.smith", "müller", "o'neil", "zoë", "renée", "s-lopez", "kim99")

#: Groups of forms of a value (SQL over id), and the settings in which they are personal data.
FORMS: dict[str, list[str]] = {
    "phone": [
        f"concat('0', {_d(1, 3)}, ' ', {_d(2, 7)})", f"concat('(', {_d(3, 3)}, ') ', {_d(4, 3)}, '-', {_d(5, 4)})", f"concat({_d(6, 3)}, '-', {_d(7, 3)}, '-', {_d(8, 4)})",
        f"concat('0', {_d(9, 2)}, '/', {_d(10, 6)})", f"concat('+', {_d(11, 2)}, ' ', {_d(12, 3)}, ' ', {_d(13, 3)})", f"concat({_d(14, 3)}, '.', {_d(15, 3)}, '.', {_d(16, 4)})",
    ],
    "secret": [
        _hex(21, 32), _hex(22, 40), _hex(23, 64), f"concat('sk_live_', {_mixed(24, 24)})", f"concat('AKIA', upper({_hex(25, 16)}))", f"concat('ghp_', {_mixed(26, 36)})", _mixed(27, 20), _mixed(28, 44),
    ],
    "address": [
        f"concat({_NAME}, ' @ example', {_d(31, 1)}, '.org')", f"concat({_NAME}, '@bücher', {_d(32, 1)}, '.example')", f"concat({_NAME}, '!', {_NAME}, '@host', {_d(33, 2)}, '.example.net')", f"concat({_NAME}, '@ mail.example')",
    ],
    "account": [f"concat({_d(41, 4)}, ' ', {_d(42, 4)}, ' ', {_d(43, 2)})", f"concat({_d(44, 3)}, '-', {_d(45, 2)}, '-', {_d(46, 4)})", _d(47, 10)],
    "card": [_d(51, 16), f"concat({_d(52, 4)}, ' ', {_d(53, 4)}, ' ', {_d(54, 4)}, ' ', {_d(55, 4)})"],
    # forms that are never personal data
    "words": [_words(61, 4, "_"), _words(66, 4, "-"), _words(71, 5, "/"), "'Donaudampfschifffahrtsgesellschaft'", "repeat('-', 24)", "repeat('=', 40)", "'internationalization'"],
    "numbers": [
        f"concat('20', {_d(81, 2)}, '-0', pmod(id, 9) + 1, '-1', pmod(id, 10), ' 1', pmod(id, 10), ':30')", f"concat('978-', {_d(82, 1)}, '-', {_d(83, 4)}, '-', {_d(84, 4)}, '-', pmod(id, 10))", f"concat(pmod(id, 9) + 1, ' ', {_d(85, 3)}, ' ', {_d(86, 3)})",
        f"concat(pmod(id, 9) + 1, '.', pmod(id, 7), '.', 300 + pmod(id, 600), '.', pmod(id, 30))", f"concat('19', {_d(87, 2)}, '-19', {_d(88, 2)}, '-20', {_d(89, 2)})", _d(90, 6), _d(92, 13),
    ],
    "marks": [f"concat('user', pmod(id, 10), '@localhost')", "'dinner @ seven'", f"concat('run', pmod(id, 10), '@home')"],
}

#: Settings: sentences around a value {x}, the first group by the data they speak of.
SETTINGS: dict[str, list[str]] = {
    "phone": ["please call {x} before noon", "tel: {x}", "my mobile is {x}, thanks", "Phone {x}", "fax {x} or write", "phone number: {x}."],
    "secret": ['token = "{x}"', "api_key: {x}", "password={x}", "Authorization: Bearer {x}", "the secret key is {x} now", "auth token {x}", '"secret": "{x}",'],
    "address": ["mail me at {x} soon", "contact {x}", "e-mail: {x}", "send it to {x}, please", "from {x} on Monday"],
    "account": ["account {x} was closed", "ssn {x}", "Konto {x}", "the account no. {x}", "ssn: {x}."],
    "card": ["card {x} expired", "charged to my card {x} today", "credit card: {x}"],
    # settings that speak of no person
    "none": ["order {x} was shipped", "in commit {x} the test", "see page {x} for more", "version {x} is out", "the sum of {x} units", "sha256 {x}", "file {x} was read", "it was {x} and then", "on {x} they came", "part {x}", "from {x} to the end", "id={x}", "there {x} the"],
}
#: Forms whose value is personal data by itself, whatever the sentence: only these are no look-alikes in a plain setting.
ALWAYS = {"address"}


def _choice(k: int, options: list[str]) -> Column:
    n = F.lit(len(options))
    at = F.pmod(F.xxhash64(F.col("id"), F.lit(k)), n)
    out = F.lit(None).cast("string")
    for i, o in enumerate(options):
        out = F.when(at == i, F.expr(o) if k % 2 else F.lit(o)).otherwise(out)
    return out


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """doc_id, text, at, upto, planted: n texts, the place of the value in each, and whether it is personal data."""
    rows = spark.range(n)
    group, setting = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(len(FORMS))), F.pmod(F.xxhash64("id", F.lit(8)), F.lit(2))
    form, own, plain = F.lit(None).cast("string"), F.lit(None).cast("string"), _choice(300, SETTINGS["none"])
    planted = F.lit(0)
    for i, (name, forms) in enumerate(FORMS.items()):
        form = F.when(group == i, _choice(101 + 2 * i, forms)).otherwise(form)
        # a look-alike stands in any group's setting: a date after "tel" is no phone number
        fits = [name] if name in SETTINGS else ["none", "phone", "secret", "address", "card"]
        own = F.when(group == i, _choice(200 + 2 * i, [s for f in fits for s in SETTINGS[f]])).otherwise(own)
        planted = F.when((group == i) & ((setting == 1) & F.lit(name in SETTINGS) | F.lit(name in ALWAYS)), 1).otherwise(planted)
    rows = rows.select("id", form.alias("value"), F.when(setting == 1, own).otherwise(plain).alias("sentence"), planted.alias("planted"))
    at = F.instr("sentence", "{x}") - 1
    text = F.replace("sentence", F.lit("{x}"), F.col("value"))
    return rows.select(F.col("id").alias("doc_id"), text.alias("text"), at.alias("at"), (at + F.length("value")).alias("upto"), "planted")
