"""Text functions as column expressions: names, similarity, guards, questions, HTML. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Threats by id, in order, and invisible characters.
THREATS = {
    "prompt_injection": r"ignore\s+(?:all\s+)?(?:previous\s+|above\s+|prior\s+)?instructions",
    "deception_hide": r"do\s+not\s+tell\s+the\s+user",
    "sys_prompt_override": r"system\s+prompt\s+override",
    "disregard_rules": r"disregard\s+(your|all|any)\s+(instructions|rules|guidelines)",
    "bypass_restrictions": r"act\s+as\s+(if|though)\s+you\s+(have\s+no|don't\s+have)\s+(restrictions|limits|rules)",
    "html_comment_injection": r"<!--[^>]*(?:ignore|override|system|secret|hidden)[^>]*-->",
    "hidden_div": r"""<\s*div\s+style\s*=\s*["'].*display\s*:\s*none""",
    "translate_execute": r"translate\s+.*into\s+.*and\s+(execute|run|eval)",
    "exfil_curl": r"curl\s+[^\n]*\$\{?\w*(KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL|API)",
    "read_secrets": r"cat\s+[^\n]*(\.env|credentials|\.netrc|\.pgpass)",
}
INVISIBLE = ["\u200b", "\u200c", "\u200d", "\u2060", "\ufeff", "\u202a", "\u202b", "\u202c", "\u202d", "\u202e"]
#: Alias groups, canonical name first.
ALIASES = {
    "javascript": ["js", "ecmascript", "es6", "es2015", "es2020", "es2023"],
    "typescript": ["ts"],
    "react.js": ["react", "reactjs"],
    "vue.js": ["vue", "vuejs"],
    "next.js": ["next", "nextjs"],
    "node.js": ["node", "nodejs"],
    "express.js": ["express", "expressjs"],
    "python": ["py", "python3"],
    "golang": ["go"],
    "kubernetes": ["k8s"],
    "postgresql": ["postgres", "psql"],
    "mongodb": ["mongo"],
    "elasticsearch": ["es", "elastic"],
    "amazon web services": ["aws"],
    "google cloud platform": ["gcp"],
    "microsoft azure": ["azure"],
    "artificial intelligence": ["ai"],
    "machine learning": ["ml"],
    "large language model": ["llm", "llms"],
    "natural language processing": ["nlp"],
    "graphql": ["gql"],
}
#: Words of questions.
INTENTS = {
    "compare": r"(?i)비교|차이|versus|vs(?![0-9A-Za-z_])|differ",
    "explain": r"(?i)설명|explain|뜻|의미|what is",
    "trend": r"(?i)트렌드|trend|변화|발전|evolution|흐름",
    "explore": r"(?i)탐색|explore|관련|연결|구조",
}
HARD_WORDS = ["compare", "explain", "analyze", "why", "how", "trade-off", "tradeoff", "difference", "pros and cons", "summarize", "summarise", "비교", "설명", "분석", "왜", "어떻게", "차이", "요약"]
KEYWORD_STOPS = [
    "the", "a", "an", "is", "in", "on", "at", "of", "to", "for", "and", "or", "not", "what",
    "how", "why", "when", "where", "who", "about", "with", "from", "are", "was", "were", "be", "been", "being",
    "이", "가", "은", "는", "을", "를", "의", "에", "에서", "로", "으로", "와", "과", "하다",
    "있다", "없다",
]
PHRASE_STOPS = [
    "은", "는", "이", "가", "의", "를", "을", "에", "에서", "로", "으로", "와", "과", "도",
    "만", "부터", "까지", "에게", "한테", "에서의", "으로의", "이란", "란", "the", "a", "an", "is", "are",
    "was", "were", "of", "in", "for", "to", "with", "and", "or", "not", "that", "this", "what", "how",
    "why", "which", "when", "가장", "어떤", "무엇", "왜", "어떻게", "현재", "최근", "주요",
]
QUERY_NOISE = [
    "AI", "LLM", "API", "CLI", "CPU", "GPU", "RAM", "OS", "IDE", "URL", "SDK", "HTTP", "JSON", "XML",
    "HTML", "CSS", "UTC", "PDF", "CSV", "YAML", "The", "This", "That", "One", "All", "Some", "New", "Old",
]
QUESTION_LIMIT, CONTEXT_LIMIT = 80, 1200
#: Entities that questions name, and entities that concepts stand for.
KNOWN_ENTITIES = [
    "Transformer", "GPT", "GPT-4", "GPT-5", "Claude", "BERT", "LLM", "RAG", "PyTorch", "TensorFlow", "CUDA", "NVIDIA",
    "OpenAI", "Anthropic", "DeepMind", "Google", "Meta", "Microsoft", "Hugging Face", "LangChain", "Neo4j", "LoRA",
    "QLoRA", "RLHF", "MCP", "Mamba", "RWKV", "Llama", "Mistral", "Constitutional AI", "ReAct", "AutoGPT", "Chinchilla",
    "EU AI Act", "Knowledge Graph", "Vector DB", "Scaling Law", "Foundation Model",
]
CONCEPT_ENTITIES = [
    (["hallucination", "환각", "grounding"], ["RLHF", "Constitutional AI", "RAG"]),
    (["mcp 프로토콜", "mcp protocol", "mcp 목적", "mcp 구조"], ["Anthropic", "MCP"]),
    (["ai agent", "agent 아키텍처", "agent 구성", "에이전트 아키텍처", "에이전트 구성"], ["LangChain", "AutoGPT", "ReAct"]),
    (["transformer 대안", "attention 대안", "이후 등장한", "대안 아키텍처"], ["Mamba", "RWKV"]),
    (["gpu 부족", "gpu shortage", "gpu 대응", "inference 최적화"], ["NVIDIA", "CUDA"]),
    (["ai 안전성", "ai safety", "alignment 연구"], ["Anthropic", "OpenAI", "DeepMind"]),
    (["오픈소스 llm", "open source llm", "open-source llm"], ["Llama", "Mistral"]),
    (["scaling law", "스케일링"], ["Chinchilla"]),
    (["fine-tuning", "파인튜닝", "parameter efficient"], ["LoRA", "QLoRA"]),
]
#: Words of relevant titles, and patterns of the modules that a repository may serve.
RELEVANT_WORDS = [
    "ai", "llm", "gpt", "claude", "gemini", "transformer", "neural", "deep learning", "machine learning", "openai",
    "anthropic", "deepseek", "diffusion", "rag", "embedding", "fine-tun", "reinforcement", "agent", "reasoning",
    "multimodal", "language model", "chatgpt", "copilot", "cursor", "stable diffusion", "midjourney", "hugging face",
    "pytorch", "tensorflow", "langchain", "vector database", "knowledge graph", "nlp", "computer vision", "robotics",
    "autonomous", "mcp", "model context protocol", "prompt", "alignment", "rlhf", "coding agent", "vibe coding",
    "inference", "quantization", "distillation", "attention", "bert", "lora", "qlora", "benchmark", "evaluation",
]
MODULES = {
    "brain": "graph|neo4j|knowledge|ontolog|entity",
    "brain/crawler": "crawl|rss|scrape|feed|news",
    "brain/graphrag": "rag|retriev|search|query",
    "eye": "simulat|predict|forecast|model",
    "ear": "discord|bot|chat|messag",
    "photo": "photo|image|edit|correct",
    "sleep": "memory|consolid|clean",
    "brain/mcp-server": "mcp|protocol|tool",
    "browse": "browser|headless|playwright",
}
#: Tones by stance, intensities by influence, words of quotes.
TONES = {"positive": "긍정적/낙관적", "negative": "부정적/비관적", "neutral": "중립적/분석적"}
INTENSITIES = {"strong": "단정적/선언적", "sure": "확신적/분석적", "careful": "관찰적/조심스러운"}
POSITIVE_WORDS = ["상승", "성장", "호재", "긍정", "기회", "강세"]
NEGATIVE_WORDS = ["하락", "위험", "악재", "우려", "약세", "위기"]


#: A word boundary between ASCII word characters and others (Java's own counts accented letters too).
EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slug(name: Column) -> Column:
    """Lower case, runs of anything else as one dash, no dash at the end (one at the start stays)."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "-+$", "")


def file_slug(path: Column) -> Column:
    """A file's name without folders, extension and date prefix, as a slug."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.\w+$", "")
    return slug(F.regexp_replace(name, r"^\d{4}-\d{2}-\d{2}-", ""))


def normal_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[._-]", ""), r"\s+", " "))


def bare_name(name: Column) -> Column:
    return F.translate(F.lower(name), " _", "")


def canonical_alias(name: Column) -> Column:
    """The canonical name of an alias group's member, else null."""
    table = {a: k for k, v in ALIASES.items() for a in [k, *v]}
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.lower(name)]


def similarity(a: Column, b: Column) -> Column:
    """Of two names: 1 if equal once normal, 0.95 for aliases, 0.9 for one within the other, else by edit distance."""
    return normal_similarity(normal_name(a), normal_name(b), canonical_alias(a) == canonical_alias(b))


def normal_similarity(na: Column, nb: Column, aliases: Column) -> Column:
    """The same of names that are normal already; aliases: whether they are names of one group."""
    short, long = F.least(F.length(na), F.length(nb)), F.greatest(F.length(na), F.length(nb))
    within = (F.contains(na, nb) | F.contains(nb, na)) & (short >= 3) & (long - short <= 3)
    edits = F.lit(1.0) - F.levenshtein(na, nb) / long
    return F.when(na == nb, 1.0).when(aliases, 0.95).when(within, 0.9).when(long == 0, 0.0).otherwise(edits)


def loosely_same(a: Column, b: Column) -> Column:
    """Equal, one within the other at over 70 % of its length, or edit similarity of 0.85."""
    na, nb = bare_name(a), bare_name(b)
    short, long = F.least(F.length(na), F.length(nb)), F.greatest(F.length(na), F.length(nb), F.lit(1))
    return (na == nb) | ((F.contains(na, nb) | F.contains(nb, na)) & (short / long > 0.7)) | (F.lit(1.0) - F.levenshtein(na, nb) / long >= 0.85)


def threats(text: Column) -> Column:
    """Ids of all threats found, invisible characters first."""
    hidden = [F.when(F.contains(text, F.lit(c)), F.lit(f"invisible_unicode_U+{ord(c):04x}")) for c in INVISIBLE]
    found = [F.when(F.regexp_like(text, F.lit("(?i)" + p)), F.lit(k)) for k, p in THREATS.items()]
    return F.array_compact(F.array(*hidden, *found))


def cleaned(text: Column) -> Column:
    """The text without invisible characters and with the first match of each threat redacted."""
    out = F.translate(text, "".join(INVISIBLE), "")
    for pattern in THREATS.values():
        out = bound(bound(out, _with_match(pattern)), _without_match)
    return out


def _with_match(pattern: str):
    return lambda t: F.struct(t.alias("text"), F.regexp_substr(t, F.lit("(?i)" + pattern)).alias("match"))


def _without_match(found: Column) -> Column:
    text, match = found["text"], found["match"]
    return F.coalesce(F.overlay(text, F.lit("[REDACTED]"), F.instr(text, match), F.length(match)), text)


def intent(question: Column) -> Column:
    out = F.lit("search")
    for name, pattern in reversed(INTENTS.items()):
        out = F.when(F.regexp_like(question, F.lit(pattern)), name).otherwise(out)
    return out


def hard_word(question: Column) -> Column:
    """The first of the words that ask for reasoning, or null."""
    lowered = F.lower(question)
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(w)), F.lit(w)) for w in HARD_WORDS])


def complexity(question: Column, context_length: Column) -> Column:
    """(tier, reasons)"""
    q = F.trim(question)
    word, marks = hard_word(q), F.regexp_count(q, F.lit("[,?.]"))
    long, clauses, wide = F.length(q) > QUESTION_LIMIT, marks > 1, context_length > CONTEXT_LIMIT
    reasons = F.array_compact(
        F.array(
            F.when(long, "long-question").otherwise("short"),
            F.when(word.isNotNull(), F.concat(F.lit("hop-word:"), word)).otherwise("no-hop-words"),
            F.when(clauses, "multi-clause"),
            F.when(wide, "wide-context"),
        )
    )
    return F.struct(F.when(long | word.isNotNull() | clauses | wide, "hard").otherwise("easy").alias("tier"), reasons.alias("reasons"))


def keyword(question: Column) -> Column:
    """The longest word that is no stop word, the first of equals; the question itself if there is none."""
    tokens = F.transform(F.split(F.lower(question), r"\s+"), lambda t: F.regexp_replace(t, "[^a-z0-9가-힣]", ""))
    ranked = F.transform(tokens, lambda t, i: F.struct(F.length(t).alias("size"), (-i).alias("place"), t.alias("word")))
    kept = F.filter(ranked, lambda t: (t["size"] >= 2) & ~t["word"].isin(KEYWORD_STOPS))
    return F.coalesce(F.array_max(kept)["word"], question)


def concept_phrases(question: Column, known: list[str] = (), most: int = 3) -> Column:
    """English words of four letters or more, then Hangul runs of three or more, without stop words and known names."""
    drop = [*PHRASE_STOPS, *[k.lower() for k in known]]
    english = F.filter(F.transform(F.regexp_extract_all(question, F.lit(EDGE + "[a-zA-Z][a-zA-Z-]{3,}" + EDGE), F.lit(0)), F.lower), lambda w: ~w.isin(drop))
    hangul = F.filter(F.regexp_extract_all(question, F.lit("[가-힣]{3,}"), F.lit(0)), lambda w: ~w.isin(PHRASE_STOPS))
    return F.slice(F.concat(F.array_distinct(english), F.array_distinct(hangul)), 1, most)


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def question_entities(question: Column, expanded: Column | None = None, most: int = 8) -> Column:
    """What a question asks about, at most so many: known names, what its concepts stand for, what the graph adds to them
    (expanded: an array), runs of capitalised words, and Hangul words.

    Each only if it is not yet there. A question without any is its own entity; one with fewer than three adds its first two
    clauses of five characters or more. A null question has none.
    """
    lowered = F.lower(question)
    known = F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(k.lower())), F.lit(k)) for k in KNOWN_ENTITIES]))
    none = F.array().cast("array<string>")
    stands_for = [F.when(has_any(lowered, words), F.array(*map(F.lit, names))).otherwise(none) for words, names in CONCEPT_ENTITIES]
    given = F.array_distinct(F.concat(known, *stands_for, F.coalesce(expanded, none) if expanded is not None else none))
    runs = F.regexp_extract_all(question, F.lit(r"[A-Z][a-zA-Z0-9-]+(?:\s[A-Z][a-zA-Z0-9-]+)*"), F.lit(0))
    hangul = F.filter(F.regexp_extract_all(question, F.lit("[가-힣]{2,}"), F.lit(0)), lambda w: ~w.isin(PHRASE_STOPS))
    clauses = F.slice(F.filter(F.split(question, r"[,?!。？]\s*"), lambda p: F.length(p) > 4), 1, 2)

    def with_runs(given: Column) -> Column:
        there, folded = F.transform(given, F.lower), F.transform(runs, F.lower)
        new = F.filter(runs, lambda w, i: (F.array_position(folded, F.lower(w)) == i + 1) & ~F.array_contains(there, F.lower(w)) & ~F.lower(w).isin(PHRASE_STOPS))
        return F.concat(given, new)

    def with_clauses(found: Column) -> Column:
        wider = F.array_distinct(F.concat(found, F.transform(F.array_except(clauses, found), F.trim)))
        return F.when(F.size(found) == 0, F.array(question)).when(F.size(found) < 3, wider).otherwise(found)

    with_hangul = bound(bound(given, with_runs), lambda found: F.concat(found, F.array_except(hangul, found)))
    return F.when(question.isNotNull(), F.slice(bound(with_hangul, with_clauses), 1, most)).otherwise(none)


def relevant(title: Column, url: Column) -> Column:
    """Whether any of the words stands in the title or the address, in any case; missing ones are empty."""
    return has_any(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit("")))), RELEVANT_WORDS)


def modules(text: Column) -> Column:
    """Modules whose pattern a text has, in order; "general" if none."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(F.regexp_like(lowered, F.lit(p)), F.lit(m)) for m, p in MODULES.items()]))
    return bound(found, lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(F.lit("general"))))


def tone(stance: Column) -> Column:
    value = F.coalesce(stance, F.lit(0.0))
    return F.when(value > 0.3, TONES["positive"]).when(value < -0.3, TONES["negative"]).otherwise(TONES["neutral"])


def intensity(influence: Column) -> Column:
    value = F.coalesce(influence, F.lit(0.0))
    return F.when(value > 0.7, INTENSITIES["strong"]).when(value > 0.4, INTENSITIES["sure"]).otherwise(INTENSITIES["careful"])


def quote_fits(quote: Column, tone: Column) -> Column:
    """False if a quote only has words against its speaker's tone."""
    text = F.coalesce(quote, F.lit(""))
    good, bad = has_any(text, POSITIVE_WORDS), has_any(text, NEGATIVE_WORDS)
    against = ((tone == TONES["positive"]) & bad & ~good) | ((tone == TONES["negative"]) & good & ~bad)
    return ~F.coalesce(against, F.lit(False))


def clean_name(name: Column) -> Column:
    return F.trim(F.replace(name, F.lit("_"), F.lit(" ")))


def percent(value: Column) -> Column:
    """A share as whole percent, halves to the even one."""
    return F.concat(F.bround(value * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def fixed(value: Column, places: int = 4) -> Column:
    """A score with so many decimals, halves to the even one."""
    return F.format_string(f"%.{places}f", F.bround(value, places))


def tech_tokens(text: Column) -> Column:
    """Capitalised names of one or two words, without common noise."""
    found = F.regexp_extract_all(text, F.lit(EDGE + r"([A-Z][a-zA-Z0-9+.#-]+(?:\s[A-Z][a-zA-Z0-9+.#-]+)?)" + EDGE), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(QUERY_NOISE)))


def search_queries(tokens: Column, qualifier: str = "typescript") -> Column:
    """The first three tokens with a qualifier, and the first alone; four at most."""
    top = F.transform(F.slice(tokens, 1, 3), lambda t: F.concat(F.lower(t), F.lit(f" {qualifier}")))
    return F.slice(F.array_distinct(F.concat(top, F.transform(F.slice(tokens, 1, 1), F.lower))), 1, 4)


def cited_names(answer: Column) -> Column:
    found = F.regexp_extract_all(answer, F.lit(EDGE + r"[A-Z][A-Za-z0-9-]{1,}(?:\s[A-Z][A-Za-z0-9-]+)*" + EDGE), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~F.lower(t).isin("the", "a", "an", "and", "or", "is", "was", "in", "on", "for", "to", "by")))


def word_windows(question: Column, width: int = 3) -> Column:
    """Windows of three words if there are more, else the question alone."""
    parts = F.split(F.trim(question), r"\s+")
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, width), " "))
    return F.when(F.size(parts) > width, spans).otherwise(F.array(F.array_join(parts, " ")))


def tags(text: Column, registry: dict[str, list[str]], default: str | None = None) -> Column:
    """Names of the entries of which any word is in the text."""
    lowered = F.lower(text)
    found = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in words]), F.lit(name)) for name, words in registry.items()]))
    return found if default is None else F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def html_to_text(html: Column, most: int = 50_000) -> Column:
    """Readable lines of a page: no scripts or furniture, the main part if marked, entities decoded, short lines dropped."""
    out = html
    for tag in ("script", "style", "nav", "footer", "header", "aside", "noscript"):
        out = F.regexp_replace(out, rf"(?i)<{tag}[\s\S]*?</{tag}>", "")
    out = F.regexp_replace(out, r"<!--[\s\S]*?-->", "")
    parts = [r"(?i)<article[\s\S]*?</article>", r"(?i)<main[\s\S]*?</main>", r'(?i)<div[^>]*class="[^"]*(?:content|article|post|entry|body)[^"]*"[\s\S]*?</div>']
    out = F.coalesce(*[F.regexp_substr(out, F.lit(p)) for p in parts], out)
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|h[1-6]|li|tr|blockquote|pre|section)[^>]*>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", "")
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(name), F.lit(char))
    out = decode_numeric(out)
    lines = F.transform(F.split(out, "\n"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda line: (F.length(line) > 20) | F.regexp_like(line, F.lit(r"^[#\-*]|^\d+\.")))
    return F.substring(F.array_join(kept, "\n"), 1, most)


def decode_numeric(text: Column) -> Column:
    """&#65; and &#x41; as their characters."""
    pieces = F.split(text, "&#", -1)

    def decoded(piece: Column, i: Column) -> Column:
        hexed, dec = F.regexp_extract(piece, r"^[xX]([0-9a-fA-F]{1,6});", 1), F.regexp_extract(piece, r"^([0-9]{1,7});", 1)
        digits = F.when(hexed != "", hexed).when(dec != "", F.conv(dec, 10, 16))
        char = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        rest = F.substring(piece, F.locate(";", piece) + 1, F.length(piece))
        return F.when(i == 0, piece).when(digits.isNull(), F.concat(F.lit("&#"), piece)).otherwise(F.concat(char, rest))

    return F.array_join(F.transform(pieces, decoded), "")


def preflight(text: Column, chunk: int = 300, overlap: int = 50, batch: int = 1) -> Column:
    """(tokens, sentences, risk, chunks, calls): what a text will cost, tokens taken as a quarter of its characters."""
    tokens = F.ceil(F.length(text) / 4).cast("bigint")
    sentences = F.greatest(F.regexp_count(text, F.lit("[.?!。]")), F.lit(1))
    risk = F.when(tokens <= 3000, "low").when(tokens <= 8000, "medium").otherwise("high")
    chunks = F.greatest(F.lit(1), F.ceil(tokens / (chunk - overlap))).cast("bigint")
    batches = F.greatest(F.lit(1), F.ceil(chunks / batch)).cast("bigint")
    return F.struct(tokens.alias("tokens"), sentences.alias("sentences"), risk.alias("risk"), chunks.alias("chunks"), (batches * F.when(risk == "high", 2).otherwise(1)).cast("bigint").alias("calls"))
