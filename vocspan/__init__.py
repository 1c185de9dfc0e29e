"""Speech-corpus analytics on Spark: DataFrame operators for annotated utterances, transcripts and speaker scores."""
