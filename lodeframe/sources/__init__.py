"""Reading, joining and upserting factor tables."""
