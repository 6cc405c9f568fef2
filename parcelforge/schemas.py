"""Schemas of the engine's tables as DDL."""

from __future__ import annotations

DEAL = "date STRING, agent STRING, asset_name STRING, country STRING, town STRING, address STRING, postcode STRING, classification STRING, area_acres DOUBLE, area_sqft DOUBLE, rent_pa DOUBLE, rent_psf DOUBLE, asking_price DOUBLE, net_yield DOUBLE, reversionary_yield DOUBLE, capval_psf DOUBLE, confidence DOUBLE, raw_source STRING"
INVESTMENT_COMP = "town STRING, address STRING, date STRING, quarter STRING, style STRING, units INT, area_sqft DOUBLE, rent_pa DOUBLE, rent_psf DOUBLE, awultc DOUBLE, price DOUBLE, yield_niy DOUBLE, reversionary_yield DOUBLE, capval_psf DOUBLE, vendor STRING, purchaser STRING, comment STRING, source_deal STRING, source_file_path STRING"
OCCUPATIONAL_COMP = "source_deal STRING, tenant_name STRING, entry_type STRING, unit_name STRING, address STRING, town STRING, postcode STRING, size_sqft DOUBLE, rent_pa DOUBLE, rent_psf DOUBLE, lease_start STRING, lease_expiry STRING, break_date STRING, rent_review_date STRING, lease_term_years DOUBLE, comp_date STRING, notes STRING, source_file_path STRING"
MAIL = "gmail_message_id STRING, subject STRING, sender STRING, sender_domain STRING, date STRING, snippet STRING, body_preview STRING, has_attachments BOOLEAN, attachment_names ARRAY<STRING>, labels ARRAY<STRING>, matched_keywords ARRAY<STRING>, matched_sender BOOLEAN, matched_label BOOLEAN, thread_id STRING"
CLASSIFICATION = "gmail_message_id STRING, is_introduction BOOLEAN, confidence DOUBLE, reason STRING, suggested_asset_name STRING, suggested_town STRING"
CHANGE_LOG = "timestamp STRING, action STRING, raw_comp_id BIGINT, source_deal STRING, tenant_name STRING, field_name STRING, old_value STRING, new_value STRING, context STRING"
