"""The timer and the board over streams; run to their end they give what the batch operators give."""
