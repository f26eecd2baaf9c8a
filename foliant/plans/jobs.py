"""A facade over the operators: requests name an operation and its options, as a front end would send them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from foliant.operators import annotations, archive, compare, forms, graphs, layout, pages, pixels, reading, retrieval, search, spatial, style, widgets, workspace
from foliant.sources import html, markdown, pdf

OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "open": pdf.read_pages,
    "conditions": pdf.conditions,
    "glyphs": pdf.read_glyphs,
    "save": pdf.write_files,
    "split-ranges": pages.split_ranges,
    "split-every": pages.split_every,
    "merge": pages.merge,
    "bookmarks": pages.offsets,
    "organize": pages.organize,
    "extract": pages.extract,
    "remove": pages.remove,
    "crop": pages.crop,
    "page-numbers": pages.number,
    "redact": spatial.kept,
    "redact-spilled": spatial.spilled,
    "ocr-fresh-words": spatial.fresh_words,
    "words": spatial.words,
    "compare": compare.compare,
    "compare-markup": compare.marked,
    "flatten-status": forms.flatten_status,
    "fill-check": forms.checked_fills,
    "changed-fields": forms.changed_fields,
    "unembedded-fonts": forms.unembedded_fonts,
    "repair-report": forms.repair_report,
    "share-objects": graphs.keepers,
    "prune": graphs.unreachable,
    "paragraphs": retrieval.paragraphs,
    "parts": retrieval.parts,
    "ask": retrieval.excerpts,
    "sources": retrieval.sources,
    "headings": html.headings,
    "links": html.links,
    "assemble": workspace.assembled,
    "assemble-pages": workspace.assembled_pages,
    "renumber": graphs.renumber,
    "compress": workspace.compressed,
    "keep-smaller": workspace.smaller_files,
    "runs": layout.runs,
    "blocks": layout.blocks,
    "pack-glyphs": reading.packed,
    "searchable": reading.searchable,
    "word-at": reading.word_at,
    "line-boxes": reading.line_boxes,
    "ocr-kept-words": reading.kept_words,
    "ocr-targets": reading.unread_pages,
    "field-of": widgets.field_of,
    "widgets-of": widgets.widgets_of,
    "prune-fields": widgets.pruned,
    "set-buttons": widgets.button_states,
    "fields-to-draw": widgets.needs_drawing,
    "annotate-check": annotations.problem,
    "annotations-under": annotations.under,
    "redact-annotations": annotations.remaining,
    "flatten-marks": annotations.flatten_marks,
    "redact-marks": annotations.removal_marks,
    "appearances": annotations.appearances,
    "strip-descriptions": annotations.undescribed,
    "ink-colors": annotations.ink_and_paper,
    "pdfa-refusals": archive.refusals,
    "pdfa-entries": workspace.cleaned_entries,
    "pdfa-annotations": archive.clean_annotations,
    "pdfa-layers": archive.unique_names,
    "pdfa-intent": archive.output_intent,
    "scan-edges": pixels.edges,
    "scan-votes": pixels.votes,
    "image-spans": pixels.covered_spans,
    "image-redact": pixels.redacted,
    "print-clips": style.clips,
    "print-borders": style.borders,
    "print-fonts": style.used_fonts,
    "translate": workspace.pivoted,
    "translate-sizes": workspace.even_sizes,
    "summary-notes": workspace.summary_notes,
    "summary-markdown": markdown.summary,
    "markdown": markdown.document,
    "zip": markdown.zipped,
    "search-tools": search.search,
}
#: What needs a renderer, a browser, a speech or language model, or a library that isn't here.
OUTSIDE = frozenset(["ocr-render", "rasterize", "html-layout", "office", "generate", "protect", "unlock", "compress-images", "scan-photo"])


def run(operation: str, *tables: DataFrame, **options) -> DataFrame:
    """The result of an operation over its tables; what lies outside Spark, or isn't known, is an error that says so."""
    if operation in OUTSIDE:
        raise NotImplementedError(f"{operation} needs a library or model outside of Spark")
    if operation not in OPERATIONS:
        raise ValueError(f"no such operation: {operation}")
    return OPERATIONS[operation](*tables, **options)


def with_repair(operation: str, table: DataFrame, good: str, repair: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """Runs an operation on the rows that meet ``good`` and, after ``repair``, once more on the rest; rows that fail again stay as they are told."""
    first = run(operation, table.where(good), **options)
    second = run(operation, repair(table.where(f"not ({good})")), **options)
    return first.unionByName(second, allowMissingColumns=True)
