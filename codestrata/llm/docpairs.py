"""Functions paired with their documentation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.session import cut

#: Words that carry no information about a function on their own (en, de, fr, es).
FILLER = frozenset(
    """a an the this that these those it its is are be was of for to from in on at by with and or as not no do does which what
    function functions method methods func fn procedure routine constructor destructor ctor getter setter helper class object member
    implementation implements implement wrapper call calls called calling run runs performs perform used use uses default given value values
    parameter parameters param params arg args argument arguments return returns returned result results raise raises throws throw type types rtype yield yields
    note notes example examples usage description summary docstring documentation doc docs self cls none null void str int float bool bytes list dict set tuple any optional
    die der das ein eine funktion methode gibt zurück wert werte beschreibung parameter
    le la les un une des du de fonction méthode retourne renvoie valeur description
    el los las una unos función método devuelve valor valores descripción""".split()
)
_REMARK = re.compile(
    r"""^(?:
      (?:todo|fixme|xxx|tbd|wip|hack)\b.*
    | n\s*[/.]?\s*a\.? | none | pass | null | nil | empty | placeholder | stub | undocumented | unknown | inherited | deprecated | internal
    | (?:auto[\s-]*)?generated(?:\s+(?:method|function|constructor|docstring|doc|comment|code|documentation))?(?:\s+stub)? | (?:method|function)\s+stub | auto[\s-]*generated.*
    | (?:please\s+)?(?:add|write|insert|put|enter|your)\s+(?:a\s+|the\s+|your\s+)?(?:description|documentation|docs?|docstring|comment|text)s?(?:\s+(?:here|later))?
    | (?:docstring|description|documentation|docs?|comment|text)\s+(?:goes\s+here|missing|pending|needed|to\s+(?:come|follow)|to\s+be\s+(?:done|written|added)|coming\s+soon|fehlt|manquante|pendiente)
    | (?:missing|no|without|needs?|lacks?)\s+(?:a\s+)?(?:description|documentation|docs?|docstring|comment)s?(?:\s+(?:available|yet|provided|given|here))?
    | not\s+(?:yet\s+)?(?:documented|described|implemented)(?:\s+yet)? | to\s+be\s+(?:documented|described|done|written|completed)
    | (?:undokumentiert|beschreibung\s+fehlt|noch\s+nicht\s+dokumentiert|keine\s+beschreibung|dokumentation\s+fehlt)
    | (?:à\s+compléter|à\s+documenter|non\s+documenté|sans\s+description|à\s+faire|documentation\s+manquante)
    | (?:sin\s+documentar|por\s+documentar|pendiente|sin\s+descripción|sin\s+documentación)
    | (?:see|see\s+also|cf\.?|refer\s+to|vgl\.?|siehe(?:\s+auch)?|voir(?:\s+aussi)?|véase|ver(?:\s+también)?|same\s+as|like)\b\s*:?\s*(?:the\s+|die\s+|der\s+|la\s+|le\s+|el\s+)?(?:[\w./:#`\\()<>$-]+)(?:\s+(?:class|method|function|module|file|docs?|documentation|above|below|for\s+details|type|klasse|methode|oben|unten))?
    | (?:overrides?|inherit(?:s|ed)?(?:\s+from)?|overridden(?:\s+from)?)\s*(?:the\s+)?(?:parent|base|super)?(?:\s*class)?(?:\s*(?:method|class|function|docs?|documentation))?
    | non[\s-]*javadoc | inherit\s*doc | inheritdoc
    )[\s.!:;,?…]*$""",
    re.I | re.X,
)
_TAG = re.compile(r"^\s*(?:[@:\\](?:param|parameter|arg|argument|key|keyword|tparam|type|ivar|var)\b\s*(?:\{[^}]*\}\s*)?(?:[\w\[\]<>., ]*?\s)??[*]*([\w.]+)?\s*:?|[@:\\](?:returns?|rtype|raises?|throws?|exception|yields?|since|author|version|deprecated|see|link|todo|override)\b\s*:?)", re.I)
_SEE = re.compile(r"^\s*(?:[@:\\](?:see|link|author|since|version|override)\b.*|\{@\w+[^}]*\}|@inheritdoc)\s*[.]?\s*$", re.I)
_HEADING = re.compile(r"^\s*(?:#+\s*)?(?:args?|arguments?|parameters?|params?|returns?|raises?|throws?|yields?|examples?|notes?|description|summary|attributes|see also|usage|inputs?|outputs?|remarks?|warnings?)\s*:?\s*$", re.I)
_MARKS = re.compile(r'^\s*(?:/\*+!?|\*+/|\*+|///?!?|#+|--+|;+|%+|\'\'\'|r?"""|"""|<!--|-->)+|(?:\*+/|"""|\'\'\'|-->)\s*$')
_WORDS = re.compile(r"[^\W\d_]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def _stem(w: str) -> str:
    for end in ("ies", "ing", "ed", "es", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


def _split(identifier: str | None) -> set[str]:
    words = {x for part in _WORDS.findall(identifier or "") for x in (_CAMEL.sub(" ", part).lower().split() + [part.lower()])}
    return words | {_stem(x) for x in words}


def informative(doc: str | None, name: str | None, parameters: list[str], types: list[str]) -> bool:
    """Whether a docstring says something about the function beyond marks, headings, its own names, remarks and pointers."""
    if not doc or not doc.strip():
        return False
    known = set().union(_split(name), *map(_split, parameters), *map(_split, types))
    exact = {x.lower() for x in (name, *parameters) if x}
    for line in doc.splitlines():
        before = None
        while line != before:
            before, line = line, _MARKS.sub("", line)
        line = line.strip(" \t\"'`*=~_-#<>[]{}()|/\\")
        if not line or _HEADING.match(line) or _SEE.match(before):
            continue
        line = _TAG.sub("", before).strip(" \t\"'`*=~-#|")
        # "name: type" and "name (type)" entries of a section, with nothing said after them.
        entry = re.match(r"^[*]*([\w.]+)\s*(?:\(([^()]*)\))?\s*:\s*(.*)$", line)
        if entry and entry[1].lower() in exact:
            line = entry[3]
        for sentence in re.split(r"(?<=[.!?;])\s+", line):
            s = sentence.strip().strip("\"'`*=~-#<>[]{}()| ").strip()
            if not s or _REMARK.match(s):
                continue
            for w in _WORDS.findall(s):
                parts = [x.lower() for x in _CAMEL.sub(" ", w).split()]
                if any(x not in FILLER and x not in known and _stem(x) not in known and not x.isdigit() and len(x) > 1 for x in parts):
                    return True
    return False


@F.pandas_udf(T.BooleanType())
def _informative(doc: pd.Series, name: pd.Series, parameters: pd.Series, types: pd.Series) -> pd.Series:
    lists = lambda v: [x for x in v if x is not None] if v is not None else []
    return pd.Series([informative(d, n, lists(p), lists(t)) for d, n, p, t in zip(doc, name, parameters, types)], dtype=bool)


def normalised_signature(signature: Column) -> Column:
    """A signature without blanks, defaults, modifiers and return annotation, in lower case: equal for equal overloads."""
    s = F.regexp_replace(F.lower(signature), r"\s+", " ")
    s = F.regexp_replace(s, r"^(?:async |def |public |private |protected |static |final |virtual |inline |override )+", "")
    s = F.regexp_replace(s, r"\s*=\s*(?:'[^']*'|\"[^\"]*\"|[^,()]*(?:\([^()]*\))?)([,)])", "$1")
    return F.regexp_replace(F.regexp_replace(s, r"\)\s*(?:->.*|:.*|const.*|throws.*)$", ")"), r"\s+", "")


def symbol_table(functions: DataFrame) -> DataFrame:
    """(uid, symbol, overload, signature, own, declaration, and what the filter reads) of functions with a signature.

    A symbol is the repository, the class and the name; overloads of a symbol are told apart by their normalised
    signature. `own` is the docstring, null where blank.
    """
    symbol = F.concat_ws(".", F.coalesce("repo", F.lit("")), F.nullif("parent_class", F.lit("")), F.coalesce("name", F.lit("")))
    blank = lambda c: F.col(c).isNull() | (F.regexp_replace(c, r"(?U)\s+", "") == "")
    listed = F.coalesce("parameters", F.array().cast("array<struct<name:string,type_hint:string>>"))
    return functions.where(~blank("signature")).select(
        "uid", "signature", "name", F.when(~blank("docstring"), F.col("docstring")).alias("own"), symbol.alias("symbol"), normalised_signature(F.col("signature")).alias("overload"),
        F.transform(listed, lambda p: p["name"]).alias("_names"), F.concat(F.transform(listed, lambda p: p["type_hint"]), F.array("return_type")).alias("_types"),
    )


def documented_functions(functions: DataFrame) -> DataFrame:
    """(unique_id, symbol, signature, description, doc_source) of functions with documentation that says something.

    functions(uid, repo, name, parent_class, signature, docstring, parameters, return_type), one row per uid. Documentation
    is judged where it is declared, before any is chosen: a trivial one never hides another. A function whose own says
    nothing takes that of a declaration of the same overload elsewhere in the repository (the least id of several):
    doc_source is then 'declaration', else 'own'. Only one declaration of an overload goes into the join, so an overload
    that a third of all functions share is no pair of all its functions. Rows without a signature or with a blank one and
    repeated rows give nothing more; null names and parameters are read as empty.
    """
    table = symbol_table(functions)
    # Evaluated once: the built-in tests settle blank documentation and repetitions of the name, Python sees the rest.
    says = F.when(F.col("own").isNull() | (F.lower(F.trim("own")) == F.lower(F.coalesce("name", F.lit("")))), F.lit(None)).otherwise(F.col("own"))
    judged = cut(table.withColumn("_doc", says).withColumn("own", F.when(F.col("_doc").isNotNull() & _informative("_doc", "name", "_names", "_types"), F.col("_doc"))).select("uid", "symbol", "overload", "signature", "own"))
    declared = judged.where(F.col("own").isNotNull()).groupBy("symbol", "overload").agg(F.min(F.struct("uid", "own")).alias("_d")).select("symbol", "overload", F.col("_d.own").alias("_declared"))
    bare = judged.where(F.col("own").isNull()).join(declared, ["symbol", "overload"]).select("uid", "symbol", "signature", F.col("_declared").alias("description"), F.lit("declaration").alias("doc_source"))
    own = judged.where(F.col("own").isNotNull()).select("uid", "symbol", "signature", F.col("own").alias("description"), F.lit("own").alias("doc_source"))
    return own.unionByName(bare).withColumnRenamed("uid", "unique_id")
