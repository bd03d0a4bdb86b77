"""Fixed values.

Everything in this module is a fixed value that has to equal the behaviour
being reproduced (marker strings, word lists, label sets, patterns).  They are
listed plainly, in natural order, and are not derived from anything.
"""

# ---------------------------------------------------------------------------
# Reply protocol
# ---------------------------------------------------------------------------
STOP_MARKER = "<EOT>"

# Lines of a reply that merely echo the question are dropped (lower-case prefix test).
ECHO_PREFIXES = ("sentence:", "noun phrase:", "respond", "examples:")

# Literal placeholder answers that count as "no correction given".
PLACEHOLDERS = ("<noun phrase>", "<corrected noun phrase>", "noun phrase", "corrected noun phrase")

# Quote characters stripped from both ends of a correction.
QUOTE_CHARS = "\"“”'‘’"

# ---------------------------------------------------------------------------
# Patterns (Java regex). Placeholders: {s} = one whitespace character in
# the sense of Python's str.isspace, {d} = one decimal digit, {w} = one word character.
# \A and \z anchor the whole string.
# ---------------------------------------------------------------------------
PAT_ANSWER_PREFIX = r"(?iu)\A{s}*\**{s}*answer{s}*[:\-]*{s}*"
PAT_NUMBERING = r"\A{s}*(?:\(?{d}+\)?[.)-]{s}*)"
PAT_VERDICT = r"(?isu)\A{s}*{word}{s}*[:\-]?{s}*(.*)\z"
VERDICT_WORDS = (("yes", "yes"), ("no", "no"), ("a", "yes"), ("b", "no"))   # (word, verdict), in order
PAT_FALLBACK = r"(?iu)(?<!{w})(yes|no)(?!{w})[:\-]?{s}*([^\n]*)"
PAT_BOILERPLATE = r"(?iu)\A{s}*(?:followed by|is|should be|output(?: is)?|answer(?: is)?){s}+"
PAT_LEADING_PUNCT = r"\A{s}*[,;:–—-]{s}*"
PAT_TRAILING_NP_PUNCT = r"[.,;:]+\z"
PAT_UNSAFE_NAME = r"[^A-Za-z0-9._-]+"
PAT_LINE_CLASS = r",{s}*{gold}{s}*,[^,]*,{s}*{pred}{s}*(?:,|\z)"
LINE_CLASSES = (("tp", "yes", "yes"), ("fn", "yes", "no"), ("fp", "no", "yes"), ("tn", "no", "no"))  # in order
HEADER_PREFIX = "sentence,"
PAT_CONTINUATION = r"\\[ \t]*(?:\r\n|\n|\z)"
PAT_COMMAND = r"(?:\A|\n){s}*(?:python3?|/usr/bin/python[0-9.]*){s}+[^\\\n]*{program}[^\n]*"
PAT_ARGUMENT = r"--{name}(?:{s}+|=)(\"[^\"]*\"|'[^']*'|[^{ws}\"']+)"

# ---------------------------------------------------------------------------
# Text cleaning and labels
# ---------------------------------------------------------------------------
# Cleaned values equal (case-insensitively) to one of these become "".
MISSING_TOKENS = ("", "nan", "none", "nat", "null")

# Strings a pandas CSV reader turns into NaN before cleaning (pandas 2.x default list).
PANDAS_NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

STRICT_YES = ("a", "yes")
STRICT_NO = ("b", "no")
WIDE_YES = ("a", "yes", "y", "true", "1")
WIDE_NO = ("b", "no", "n", "false", "0")
EVAL_EXTRA_YES = ("y", "true", "1")
EVAL_EXTRA_NO = ("n", "false", "0")

# Ground-truth / prediction column candidates, in preference order.
TRUTH_COLUMNS = ("grammatical", "grammatical_gt")
PREDICTION_COLUMNS = ("grammatical_pred", "prediction")

# Messages for files whose columns can't be found.
ERROR_NO_TRUTH = "Could not detect ground-truth column"
ERROR_NO_PREDICTION = "Could not detect prediction column"
ERROR_EMPTY_FILE = "No columns to parse from file"
# Errors whose message in the reference goes on with a line or a byte of the file.
ERROR_OPEN_QUOTE = "Error tokenizing data. C error: EOF inside string"
ERROR_TOO_MANY_FIELDS = "Error tokenizing data. C error: Expected fewer fields"
ERROR_CHARSET = "'utf-8' codec can't decode"
ERROR_TIMEOUT = "Timeout waiting for predictions to be created/updated"

BENCHMARK_COLUMNS = ("sentence", "noun_phrase", "grammatical", "corrected")
PREDICTION_TABLE_COLUMNS = BENCHMARK_COLUMNS + ("grammatical_pred", "correction")

# ---------------------------------------------------------------------------
# Determiner detector and taggers
# ---------------------------------------------------------------------------
DETERMINERS = ("the", "a")
INSERTED_DETERMINER = "the"
DETERMINER_TAGS = ("determiner", "article")
MISSING_TRIGGER_TAGS = ("noun", "adjective")
TOP_NEXT_WORDS = 100          # only the first 100 next words are consulted
NEXT_WORD_K = 10000           # size of the next-word list asked for
IOB_PREFACE = "Here is the output: "

# Rule tagger (closed-class lexicon, then suffix rules, else noun).
LEXICON = (
    ("article", ("the", "a", "an")),
    ("determiner", ("this", "that", "these", "those", "my", "your", "his", "her", "its",
                    "our", "their", "some", "any", "no", "every", "each")),
    ("preposition", ("of", "in", "on", "at", "by", "for", "with", "from", "to", "into", "as")),
    ("conjunction", ("and", "or", "but", "if", "because", "while")),
    ("pronoun", ("i", "you", "he", "she", "it", "we", "they", "me", "him", "us", "them")),
    ("verb", ("is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does",
              "did", "will", "would", "can", "could")),
    ("adverb", ("not", "very", "too", "also")),
)
SUFFIX_RULES = (
    ("ly", "adverb"),
    ("ing", "verb"),
    ("ed", "verb"),
    ("ous", "adjective"),
    ("ful", "adjective"),
    ("ive", "adjective"),
    ("ble", "adjective"),
    ("al", "adjective"),
)
DEFAULT_TAG = "noun"
NP_TAGS = ("article", "determiner", "adjective", "noun", "propernoun", "pronoun")

# ---------------------------------------------------------------------------
# evaluation
# ---------------------------------------------------------------------------
METRIC_NAMES = ("accuracy", "f1", "precision", "recall")        # sorted, as reported
CONFUSION_NAMES = ("fn", "fp", "n_total", "tn", "tp")           # sorted, as reported
PREDICTIONS_SUFFIX = "__predictions.csv"
DEFAULT_PREDICTIONS_GLOB = "*__predictions.csv"
DEFAULT_RUNS = 10

# ---------------------------------------------------------------------------
# Golden reply templates used by the default scorer.
# {np} = the noun phrase, {alt} = the other determiner + the same noun.
# ---------------------------------------------------------------------------
REPLY_TEMPLATES = (
    "yes<EOT>",
    "YES: fine",
    "no {alt}<EOT>",
    "no {np}<EOT>",
    "No - \"{alt}.\"",
    "no <corrected noun phrase>",
    "no",
    "1. Answer: no {alt}",
    "**Answer: no {alt}",
    "B: {alt}",
    "Because {alt}",
    "not sure",
    "",
    "I think no {alt}",
    "Sentence: foo\nno {alt}",
    "Respond no",
    "no: is {alt}",
    "Yesterday",
    "2) no 3. “{alt}”",
    "I say no {alt}\nthanks",
    "<EOT> no",
    "no is is {alt}",
)

# The stand-in language model's whole vocabulary (our choice).
STAND_IN_VOCABULARY = ("a", "an", "and", "in", "is", "of", "that", "the", "to", "was")
