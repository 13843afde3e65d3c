"""quireflow: documentation-site analytics as Spark jobs.

Captured sites go in as tables (pages, sitemaps, responses, source text),
checked books come out as tables (chapters, contents, manifest, findings).
Every step is a lazy DataFrame function that works over many sites at once.
"""

__version__ = "0.1.0"
