"""Layer-level compositions: clean, enrich and profile whole layers."""
