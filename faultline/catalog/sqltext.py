"""SQL forms of the text normalisation and term vectors, sharing patterns and word lists."""

from __future__ import annotations

from faultline.catalog.views import quoted, sql_list
from faultline.functions import lexicon, text


def _in(items) -> str:
    return "(" + ", ".join(quoted(item) for item in items) + ")"


def split_joined(column: str) -> str:
    for first, second in text.JOINED:
        column = f"regexp_replace({column}, '\\b{first}{second}\\b', '{first} {second}', 'g')"
    return column


def core_tokens(column: str) -> str:
    spaced = f"translate(lower({column}), {quoted(text.SEPARATORS)}, {quoted(' ' * len(text.SEPARATORS))})"
    spaced = f"replace(replace({spaced}, '--', ' '), '...', ' ')"
    spaced = f"regexp_replace({spaced}, {quoted(text.COMMA_OR_COLON)}, ' \\2', 'g')"
    spaced = f"regexp_replace({spaced}, {quoted(text.CLOSING)}, '\\1', 'g')"
    spaced = split_joined(spaced)
    return (
        f"list_filter(string_split({spaced}, ' '), "
        f"lambda w: regexp_matches(w, {quoted(text.WORD)}) and w not in {_in(lexicon.STOPWORDS)})"
    )


def api_tokens(column: str) -> str:
    letters = f"regexp_replace(lower(coalesce({column}, '')), '[^a-z]+', ' ', 'g')"
    letters = split_joined(letters)
    return (
        f"list_filter(string_split({letters}, ' '), "
        f"lambda w: length(w) > 2 and w not in {_in(lexicon.STOPWORDS)})"
    )


def lemma(word: str) -> str:
    irregular = " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in lexicon.IRREGULAR_NOUNS.items())
    return (
        f"case when {word} in {_in(lexicon.IRREGULAR_NOUNS)} then case {word} {irregular} end "
        f"when ends_with({word}, 'ies') and length({word}) >= 5 then left({word}, length({word}) - 3) || 'y' "
        f"when regexp_matches({word}, '(?:ss|x|z|ch|sh)es$') then left({word}, length({word}) - 2) "
        f"when ends_with({word}, 'men') and length({word}) >= 5 then left({word}, length({word}) - 3) || 'man' "
        f"when length({word}) >= 4 and regexp_matches({word}, '[^siu]s$') then left({word}, length({word}) - 1) "
        f"else {word} end"
    )


def normalise(column: str, profile: str = "core") -> str:
    tokens = {"core": core_tokens, "api": api_tokens}[profile](column)
    return f"array_to_string(list_transform({tokens}, lambda w: {lemma('w')}), ' ')"


def vector_words(processed: str) -> str:
    ignored = lexicon.STOPWORDS + lexicon.VECTOR_STOPWORDS
    return (
        f"list_filter(string_split({processed}, ' '), "
        f"lambda w: length(w) >= 2 and w not in {_in(ignored)})"
    )


def term_views(
    source: str, features: int, corpus: str | None = None, profile: str = "core"
) -> dict[str, str]:
    """Views from a (id, narrative) source: terms, vocab with idf, unit weights.

    `corpus` names a (id, narrative) view the vocabulary is counted on, the source by default;
    the vocabulary is always one of core-normalised text, `profile` is that of the source.
    """

    def term_rows(name: str, profile: str) -> str:
        return f"""
            select id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term
            from (select id, {vector_words("p")} as w
                  from (select id, coalesce({normalise("narrative", profile)}, '') as p from {name}) a) b
        """

    fitted = corpus or source
    views = {
        "terms": term_rows(source, profile),
        "fit_terms": term_rows(fitted, "core"),
        "vocab": f"""
            select term, cf, df, ln((1.0 + (select count(*) from {fitted})) / (1.0 + df)) + 1.0 as idf
            from (select term, count(*) as cf, count(distinct id) as df from fit_terms
                  group by term order by cf desc, term limit {features}) v
        """,
        "raw": """
            select t.id, t.term, count(*) * any_value(v.idf) as w from terms t join vocab v on v.term = t.term
            group by t.id, t.term
        """,
        "weights": "select id, term, w / sqrt(sum(w * w) over (partition by id)) as weight from raw",
    }
    return views
