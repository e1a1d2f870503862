from panelscope.streaming.rounds import start_round_ingest

__all__ = ["start_round_ingest"]
