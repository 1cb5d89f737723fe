"""The tables' schemas, stated rather than inferred."""

from __future__ import annotations

SCHEMAS = {
    "poets": "id BIGINT, name STRING, name_urdu STRING, slug STRING, bio_english STRING, bio_urdu STRING, birth_year INT, death_year INT, wikipedia_url STRING",
    "books": "id BIGINT, poet_id BIGINT, name STRING, name_urdu STRING",
    "texts": "id BIGINT, public_id STRING, poet_id BIGINT, book_id BIGINT, contributor_id BIGINT, title_urdu STRING, title_english STRING, text_urdu STRING, text_english STRING, form STRING, verse_count INT, content_hash STRING, first_couplet_hash STRING, normalized_text STRING, nlp_processed BOOLEAN, nlp_version INT, is_deleted BOOLEAN, created_at TIMESTAMP_NTZ",
    "verses": "text_id BIGINT, couplet_index INT, misra1_urdu STRING, misra2_urdu STRING, misra1_english STRING, misra2_english STRING, is_matla BOOLEAN, is_maqta BOOLEAN",
    "contributors": "id BIGINT, name STRING, email STRING",
    "contributions": "text_id BIGINT, contributor_id BIGINT, role STRING",
    "poetic_features": "text_id BIGINT, radif STRING, radif_confidence DOUBLE, qaafiya ARRAY<STRING>, qaafiya_pattern STRING, theme STRING, maqta_detected BOOLEAN, meter_name STRING, meter_pattern STRING, meter_confidence DOUBLE, created_at TIMESTAMP_NTZ",
    "ghazal_embeddings": "text_id BIGINT, embedding_vector ARRAY<FLOAT>, embedding_norm DOUBLE, updated_at TIMESTAMP_NTZ",
    "bulk_preview": "item_id BIGINT, batch_no BIGINT, arrived_at TIMESTAMP_NTZ, poet_id BIGINT, contributor_id BIGINT, full_text STRING, content_hash STRING, first_couplet_hash STRING, normalized_text STRING",
    "poet_fingerprints": "poet_id BIGINT, avg_embedding ARRAY<DOUBLE>, stylistic_features STRING, updated_at TIMESTAMP_NTZ",
    "poet_predictions": "text_id BIGINT, predicted_poet_id BIGINT, confidence DOUBLE, top3 STRING, feature_contributions STRING, updated_at TIMESTAMP_NTZ",
    "meter_patterns": "pattern STRING, frequency BIGINT, example_text_id BIGINT",
}
