"""Column functions on strings. Null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_form(c: Column) -> Column:
    """Lower-cased, trimmed, inner runs of white space made one space; blank strings become empty."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def ref_key(c: Column) -> Column:
    """A key as referred to: trimmed of all white space and lower-cased; blank becomes null."""
    k = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(k != "", k)


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for empty or null."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((n + 3) / 4))).cast("int")


def preview(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def truncate(c: Column, n: int, marker: str = "...") -> Column:
    """At most ``n`` characters, the last of them ``marker`` where something was cut off."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - len(marker)), F.lit(marker))).otherwise(c)


def strip_ansi(c: Column) -> Column:
    """Without terminal colour and cursor sequences."""
    return F.regexp_replace(c, "\x1b\\[[0-9;?]*[A-Za-z]", "")


def strip_tags(c: Column, tags: list[str]) -> Column:
    """Without the named tags and what they enclose; trimmed."""
    for t in tags:
        c = F.regexp_replace(c, f"(?s)<{t}>.*?</{t}>", "")
    return F.trim(c)


def rewrite_command(c: Column) -> Column:
    """A message that is a wrapped command as ``/name arguments``; other texts as they are. Trimmed."""
    wrapped = r"(?s)^<command-name>/(\w+)</command-name>\s*<command-message>\w+</command-message>\s*<command-args>(.*?)</command-args>"
    name, args = F.regexp_extract(c, wrapped, 1), F.trim(F.regexp_extract(c, wrapped, 2))
    return F.trim(F.when(name != "", F.concat(F.lit("/"), name, F.when(args != "", F.concat(F.lit(" "), args)).otherwise(""))).otherwise(c))


def section(c: Column, heading: str) -> Column:
    """Text below ``## heading`` up to the next heading of that level or the end; empty if there is none."""
    return F.trim(F.regexp_extract(c, rf"(?s)(?:^|\n)## {heading}[^\n]*\n(.*?)(?=\n## |$)", 1))


def labelled_line(c: Column, key: str) -> Column:
    """Rest of the first line that begins with ``key:``; empty if there is none."""
    return F.trim(F.regexp_extract(c, rf"(?m)^{key}:[ \t]*([^\n]*)$", 1))


def title_case(c: Column) -> Column:
    """Title Case from kebab-case."""
    return F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))


def stable_id(*parts: Column, length: int = 32) -> Column:
    """A deterministic id from the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def normalized_block_hash(c: Column) -> Column:
    """md5 of a text block regardless of case and white space."""
    return F.md5(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))))


def commit_message(c: Column) -> Column:
    """Message of a ``git commit`` command: the quoted -m argument, else the here-document; trimmed, 200 characters. An
    argument that itself opens a here-document is read from that."""
    quoted = F.trim(F.regexp_extract(c, r"(?s)-m\s+[\"'](.*?)[\"']", 1))
    here = F.trim(F.regexp_extract(c, r"(?s)EOF['\"]?\s*\n(.*?)\n\s*EOF", 1))
    return F.substring(F.when((quoted != "") & ~quoted.startswith("$("), quoted).otherwise(here), 1, 200)


def commit_flags(c: Column) -> Column:
    """(amend, no_verify, co_author): what a ``git commit`` command asks for; a struct, all false for null."""
    has = lambda s: F.coalesce(c.contains(s), F.lit(False))
    return F.struct(has("--amend").alias("amend"), has("--no-verify").alias("no_verify"), has("Co-Authored-By").alias("co_author"))


# What makes a user's turn look like a question, and texts that say nothing.
QUESTION = r"(?i)\?|how |why |what |wait |i don't|doesn't|so you|that means|i see|explain|confused|understand|difference between|what's the"
PLACEHOLDERS = ["", "none", "unknown", "n/a", "[haiku unavailable]", "[no transcript available]", "(not present this session)", "[haiku unavailable — session cleared]"]


def asks(c: Column) -> Column:
    """Whether a text has a sign of a question; false for null."""
    return F.coalesce(c.rlike(QUESTION), F.lit(False))


def meaningful(c: Column) -> Column:
    """Whether a text says something: no placeholder, and more than ten characters when trimmed; false for null."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.coalesce(~F.lower(t).isin(PLACEHOLDERS) & (F.length(t) > 10), F.lit(False))


def valid_pair(question: Column, answer: Column, session: Column) -> Column:
    """Whether a question with its answer may be used: all three known, at least 10 and 5 characters when trimmed."""
    size = lambda c: F.length(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.coalesce((size(question) >= 10) & (size(answer) >= 5) & session.isNotNull(), F.lit(False))


def loads_or_empty(c: Column) -> Column:
    """A JSON list of strings as an array, each string once in order; empty for null and for what is no such list."""
    return F.array_distinct(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")))


def short_hash(c: Column, kind: str = "sha1", length: int = 16) -> Column:
    """The first hexadecimal digits of a sha1, sha256 or md5 of a text."""
    return F.substring({"sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256), "md5": F.md5}[kind](c), 1, length)


def words(c: Column) -> Column:
    """Maximal runs of word characters of the lower-cased text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([0-9a-z_]+)"), 1)


# Words that do not count in conditions and in confirmations.
CONDITION_STOPWORDS = ["evidence", "that", "the", "a", "an", "of", "or", "and", "is", "was", "were", "be", "been", "being", "this", "something"]
CONFIRM_STOPWORDS = ["the", "a", "an", "is", "was", "are", "were", "be", "been", "that", "this", "it", "of", "in", "on", "at", "to", "for"]


def keywords(c: Column, stopwords: list[str], longer_than: int = 0, distinct: bool = True) -> Column:
    """Words of a text without stop words and short words."""
    keep = F.filter(words(c), lambda w: ~w.isin(stopwords) & (F.length(w) > longer_than))
    return F.array_distinct(keep) if distinct else keep


# Name patterns by which the type of an entity is told.
FILE_ENDINGS = [".py", ".sh", ".md", ".json", ".yaml", ".yml", ".js", ".ts", ".toml"]
TOOL_PREFIXES = ["bash", "python", "node", "npm", "git", "docker", "caddy", "liquidsoap", "ffmpeg", "icecast", "nginx", "redis", "sqlite", "faiss", "xdotool", "xclip", "novnc", "vnc", "ssh", "curl", "wget", "jq", "claude", "haiku", "mcp", "twilio", "telegram"]
SERVICE_PARTS = ["youtube", "chatgpt", "openai", "anthropic", "cloudflare", "github", "google", "perplexity", "tavily", "discord", "slack", "stripe", "vultr", "digitalocean", "aws", "gcp", "azure", "spotify", "discogs"]


def infer_entity_type(name: Column, project_names: list[str] | None = None) -> Column:
    """file, tool, service, project or concept, by ordered rules on the name."""
    low = F.lower(name)
    is_file = name.contains("/") | name.startswith(".") | name.rlike("(" + "|".join(e.replace(".", r"\.") for e in FILE_ENDINGS) + ")$")
    rule = F.when(is_file, "file").when(low.rlike("^(" + "|".join(TOOL_PREFIXES) + ")"), "tool").when(low.rlike("|".join(SERVICE_PARTS)) | name.rlike(r"^\d+\.\d+\.\d+\.\d+") | name.startswith("http"), "service")
    if project_names:
        rule = rule.when(name.isin(project_names) | low.isin(project_names), "project")
    return rule.otherwise("concept")


# Signs of past events and of procedures.
EPISODIC = "happened|occurred|deployed|shipped|fixed|broke|discovered|found|session|yesterday|today|last week|incident|outage|error|failed|succeeded|merged|commit|released|launched|ran|tried|observed"
PROCEDURAL = "always|never|must|should|when you|to do|steps|procedure|workflow|pattern|recipe|rule|template|how to|make sure|remember to|approach"


def memory_class(content: Column, topic: Column, atom_type: Column) -> Column:
    """episodic, procedural or semantic. Null content, topic or type count as empty."""
    text = F.lower(F.concat(F.coalesce(content, F.lit("")), F.lit(" "), F.coalesce(topic, F.lit(""))))
    kind = F.coalesce(atom_type, F.lit(""))
    return F.when(kind.isin("outcome", "failure") | text.rlike(rf"\b({EPISODIC})\b"), "episodic").when(kind.isin("pattern", "gotcha") | text.rlike(rf"\b({PROCEDURAL})\b"), "procedural").otherwise("semantic")


def initial_world(form_type: Column) -> Column:
    """World in which a new form starts."""
    return F.when(form_type == "plan", "planned").when(form_type == "question", "possible").when(form_type == "preference", "user_belief").otherwise("current")


def disconfirmation_conditions(form_type: Column, content: Column, subject: Column, predicate: Column, obj: Column) -> Column:
    """Array of sentences that say which evidence would speak against a form; wording is fixed."""
    s, p, o = (F.coalesce(c, F.lit("")) for c in (subject, predicate, obj))
    against = F.array(F.concat(F.lit("Evidence contradicting: "), F.coalesce(content, F.lit(""))))
    triple = F.array(F.concat(F.lit("Evidence that "), s, F.lit(" "), p, F.lit(" something other than "), o), F.concat(F.lit("Evidence that "), s, F.lit(" does not "), p, F.lit(" "), o))
    fixed = {
        "rule": ["Evidence that the rule was violated and the outcome was still good", "Evidence that following this rule caused a problem"],
        "warning": ["Evidence that the warned-about situation occurred without harm", "Evidence that the risk was mitigated and is no longer relevant"],
        "plan": ["Evidence that this plan was abandoned or superseded", "Evidence that the planned item was completed with a different approach"],
        "preference": ["Evidence that the preference was overridden or reversed"],
    }
    rule = F.when(form_type == "claim", F.when((s != "") & (p != "") & (o != ""), triple).otherwise(against))
    rule = rule.when(form_type == "decision", F.array(F.concat(F.lit("Evidence that the decision was reverted or replaced: "), F.coalesce(content, F.lit(""))), F.lit("Evidence that an alternative to this decision was adopted")))
    for kind, said in fixed.items():
        rule = rule.when(form_type == kind, F.array(*map(F.lit, said)))
    return rule.otherwise(against)


def has_error(c: Column) -> Column:
    """Whether a tool's answer looks like an error (case counts)."""
    return c.rlike("Error:|error:|ERROR|Traceback|FAILED|fatal:")


# Signs of an error in a tool's answer within a transcript.
TRANSCRIPT_ERRORS = ["Error:", "error:", "Traceback", "FAILED", "fatal:", "Exit code 1"]


def has_transcript_error(c: Column) -> Column:
    """As ``has_error``, by the signs that count in transcripts; false for null."""
    return F.coalesce(F.reduce(F.array(*[c.contains(e) for e in TRANSCRIPT_ERRORS]), F.lit(False), lambda a, b: a | b), F.lit(False))


# Words that are no keyword of a probe.
PROBE_STOPWORDS = [
    "the", "a", "an", "is", "was", "are", "were", "be", "been", "that", "this", "it", "of", "in", "on", "at", "to", "for", "will", "would", "should", "could", "always", "never", "not",
    "and", "or", "but", "with", "by", "from", "as", "if", "so", "do", "does", "did", "have", "has", "had", "we", "i", "you", "chose", "use", "used", "add", "after", "before", "when", "then",
]


def probe_keywords(c: Column) -> Column:
    """Words of three letters or more, no digit first, in order of first use, without stop words; case is kept, and words
    that differ in case only are one, the first."""
    found = F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\b[a-zA-Z_]\w{2,}\b)"), 1), lambda w: ~F.lower(w).isin(PROBE_STOPWORDS))
    low = F.transform(found, lambda w: F.lower(w))
    return F.filter(found, lambda w, k: F.array_position(low, F.lower(w)) == k + 1)


def file_paths(tool_inputs: Column) -> Column:
    """Paths named in an array of JSON tool inputs; inputs that are no JSON give none."""
    got = F.flatten(F.transform(tool_inputs, lambda j: F.array(*[F.get_json_object(j, f"$.{k}") for k in ("file_path", "path", "pattern", "command")])))
    return F.array_distinct(F.filter(got, lambda p: p.isNotNull() & p.contains("/")))
