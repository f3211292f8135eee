"""Settings of indexing and retrieval."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # They decide results.
    top_k: int = 15
    pool: int = 150
    keyword_limit: int = 15
    vector_min: float = 0.28
    bm25_min: float = 0.35
    source_boost: float = 0.03
    vector_weight: float = 0.75
    bm25_weight: float = 0.25
    mmr_lambda: float = 0.65
    shortlist: int = 75
    guaranteed: int = 7
    max_sentences: int = 3
    history_messages: int = 20
    session_hours: int = 6
    requests_per_minute: int = 30
    small_talk_words: int = 8
    chunk_size: int = 400
    chunk_overlap: int = 80
    boilerplate_max: int = 300
    page_chars: int = 12_000
    page_paragraphs: int = 20
    tag_min_overlap: int = 2
    index_min_chunks: int = 20


DEFAULT = Settings()
PRIMARY = ["portfolio", "resume", "research_paper", "github_repo", "github_readme"]
EXTERNAL = "external_link"
