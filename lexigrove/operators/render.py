"""Marked-up contexts and entity questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of entity queries, entity types in the order they are looked for, codes of the entity service.
ENTITY_WORDS = (
    "COVID-19", "SARS-CoV-2", "hypertension", "diabetes", "heart", "disease", "obese", "death", "HCoV-19", "HCoV",
    "coronavirus", "symptoms", "incubation", "periods", "period", "quarantine", "asymptomatic", "transmissions",
    "fecal", "excretion", "decline", "Wuhan", "mortality", "patients", "stay", "reproduction", "risk", "factor",
    "factors", "pregnancy", "interval", "absent", "reported", "length", "diagnosed", "United", "States", "isolated",
    "CDC", "WHO", "vaccine", "negative", "animals", "airbone", "spread", "blood", "sanitizer", "controlled",
    "illness", "friends",
)
ENTITY_TYPES = ("gene", "drug", "chemical compound", "target", "disease", "toxin", "transcription factor", "mirna", "pathway", "mutation")
ENTITY_CODES = {
    "gene": 8, "drug": 5, "chemical compound": 3, "target": 14, "disease": 4, "toxin": 15, "transcription factor": 16, "mirna": 10, "pathway": 12, "mutation": 17,
}


def entity_type(question: Column) -> Column:
    """The first entity type that the question names, in lower case."""
    out = F.lit("All Entity Type")
    for kind in reversed(ENTITY_TYPES):
        out = F.when(F.contains(F.lower(question), F.lit(kind)), kind).otherwise(out)
    return out


def entity_query(words: Column, known: tuple[str, ...] = ENTITY_WORDS, fallback: str = "COVID-19") -> Column:
    """Words of the question that are known entity words in lower case and no stopwords, or the fallback."""
    from lexigrove.functions.text import STOPWORDS

    lower = sorted({w.lower() for w in known} - set(STOPWORDS))
    kept = F.filter(words, lambda w: w.isin(*lower))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(fallback)


def mark_answer(context: Column, sent_start: Column, sent_end: Column, start: Column, end: Column, c_start: Column, c_end: Column) -> Column:
    """The context from c_start to c_end, its sentence in <em>, the answer in a <span>, dots where it was cut."""
    text = F.concat(
        F.when(c_start > 0, F.lit("... ")).otherwise(""),
        F.substring(context, c_start + 1, sent_start - c_start), F.lit("<em>"), F.substring(context, sent_start + 1, start - sent_start),
        F.lit("<span class='answer_span'>"), F.substring(context, start + 1, end - start), F.lit("</span>"),
        F.substring(context, end + 1, sent_end - end), F.lit("</em>"), F.substring(context, sent_end + 1, c_end - sent_end),
        F.when(c_end < F.length(context), F.lit(" ...")).otherwise(""),
    )
    return text


# Addresses of entity pages.
CHEMICAL_PAGE = "http://ctdbase.org/detail.go?type=chem&acc="
DISEASE_PAGE = "http://ctdbase.org/detail.go?type=disease&acc="
GENE_PAGE = "http://ctdbase.org/detail.go?type=gene&acc="
TAXON_PAGE = "https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?mode=Info&id="


def entity_url(identifier: Column, kind: Column) -> Column:
    """Address of an entity's page; null for identifiers without one."""
    after = lambda mark: F.substring_index(identifier, mark, -1)
    return (
        F.when(F.contains(identifier, F.lit("MESH")) & (kind == "drug"), F.concat(F.lit(CHEMICAL_PAGE), after("MESH:")))
        .when(identifier.rlike("MESH|OMIM"), F.concat(F.lit(DISEASE_PAGE), identifier))
        .when(F.contains(identifier, F.lit("NCBI:txid")), F.concat(F.lit(TAXON_PAGE), after("NCBI:txid")))
        .when(F.contains(identifier, F.lit("NCBI:gene")), F.concat(F.lit(GENE_PAGE), after("NCBI:gene")))
    )


def highlight(text: Column, entities: Column, css: str) -> Column:
    """Links around entities: array of (start, end, url), which don't overlap."""
    made = F.aggregate(
        F.array_sort(entities),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, e: F.when(e["start"] < acc["at"], acc).otherwise(
            F.struct(
                F.least(e["end"], F.length(text)).alias("at"),
                F.concat(
                    acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), F.lit("<a href='"), e["url"], F.lit(f"' target='_blank' class='{css}'>"),
                    F.substring(text, e["start"] + 1, e["end"] - e["start"]), F.lit("</a>"),
                ).alias("out"),
            )
        ),
    )
    return F.concat(made["out"], F.substring(text, made["at"] + 1, F.length(text)))
