"""Fields on storage and evidence bundles as files."""
